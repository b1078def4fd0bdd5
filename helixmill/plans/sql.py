"""SQL of the derived views and of longer oracles."""

from __future__ import annotations

from itertools import combinations_with_replacement

GENOTYPES = tuple(combinations_with_replacement(range(4), 2))

READS = """reads AS (SELECT row_number() OVER () AS uid, l_orderkey * 8 + l_linenumber AS read_id, l_orderkey AS name, 1 + l_suppkey % 3 AS chrom,
  (l_partkey * 37 + l_orderkey * 11 + l_linenumber * 5) % 50000 AS pos, 20 + CAST(floor(l_quantity) AS BIGINT) AS len,
  CAST(floor(l_extendedprice) AS BIGINT) % 61 AS mapq, l_returnflag AS rg, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_rev, l_orderkey AS k,
  l_partkey % 6 AS clip_left, l_suppkey % 6 AS clip_right,
  CASE WHEN l_linenumber < 3 AND l_orderkey % 5 > 0 THEN 20 + CAST(floor(l_quantity) AS BIGINT) - 9 + l_partkey % 70 ELSE 0 END AS tlen,
  CASE WHEN l_linenumber < 3 AND l_orderkey % 5 > 0 THEN 20 + CAST(floor(l_quantity) AS BIGINT) - 9 + l_partkey % 70 ELSE 20 + CAST(floor(l_quantity) AS BIGINT) END AS frag,
  CAST(CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END + CASE WHEN l_linenumber < 3 THEN 1 ELSE 0 END + CASE WHEN l_linenumber < 3 AND l_orderkey % 5 > 0 THEN 2 ELSE 0 END
    + CASE WHEN l_orderkey % 23 = 0 THEN 4 ELSE 0 END + CASE WHEN l_linenumber = 1 THEN 64 ELSE 0 END + CASE WHEN l_linenumber = 2 THEN 128 ELSE 0 END
    + CASE WHEN l_partkey % 17 = 0 THEN 256 ELSE 0 END + CASE WHEN l_suppkey % 13 = 0 THEN 512 ELSE 0 END + CASE WHEN l_partkey % 11 = 0 THEN 1024 ELSE 0 END
    + CASE WHEN l_partkey % 19 = 0 THEN 2048 ELSE 0 END AS INT) AS flag FROM lineitem)"""

FILTERED = f"""{READS}, filtered AS (SELECT *, CASE WHEN len NOT BETWEEN 0 AND 500 THEN 'MappedLength' WHEN flag & 1024 > 0 THEN 'Duplicate'
  WHEN (clip_left + clip_right) / (len + clip_left + clip_right) > 0.3 THEN 'SoftClipped' WHEN flag & 1 > 0 AND flag & 2 = 0 THEN 'ImproperPairs'
  WHEN flag & 4 > 0 THEN 'Unmapped' WHEN flag & 512 > 0 THEN 'FailedQC' WHEN flag & 256 > 0 THEN 'Secondary' WHEN flag & 2048 > 0 THEN 'Supplementary'
  WHEN mapq NOT BETWEEN 10 AND 50 THEN 'MappingQuality' END AS reason FROM reads)"""

BASES = f"""{READS}, bases0 AS (SELECT r.*, o.range AS off, pos + o.range AS site, (pos + o.range) * (pos + o.range + 7 * chrom) % 97 % 4 AS ref FROM reads r JOIN range(0, 70) o ON o.range < r.len),
bases AS (SELECT *, CASE WHEN (k * 31 + off * 17 + chrom) % 29 = 0 THEN (ref + 1 + (k + off) % 3) % 4 ELSE ref END AS base, 12 + (k * 7 + off * 3) % 30 AS qual FROM bases0)"""

#: The reads of views.alignments: lengths of their operations, and what follows from them.
ALIGNED = f"""{READS}, ops AS (SELECT *, len // 2 AS m1, len - len // 2 AS m2, CASE WHEN k % 5 IN (1, 4) THEN 1 + k % 3 ELSE 0 END AS ins, CASE WHEN k % 5 IN (2, 4) THEN 1 + k % 4 ELSE 0 END AS del,
  CASE WHEN k % 5 = 3 THEN 5 + k % 7 ELSE 0 END AS skip FROM reads),
aligned AS (SELECT *, len + ins AS sequenced, len + ins + clip_left + clip_right AS read_length, len + del + skip AS mapped, CASE WHEN flag & 2 > 0 THEN greatest(0, tlen + ins - del) ELSE len + ins END AS fragment FROM ops)"""

ALIGNED_BASES = f"""{ALIGNED}, spots AS (SELECT a.*, o.range AS i, CASE WHEN o.range < clip_left OR o.range >= read_length - clip_right THEN 'S' WHEN o.range >= clip_left + m1 AND o.range < clip_left + m1 + ins THEN 'I' ELSE 'M' END AS kind
  FROM aligned a JOIN range(0, 90) o ON o.range < read_length),
abases AS (SELECT uid, read_id, name, rg, chrom, is_rev, flag, i, kind, CASE kind WHEN 'M' THEN pos + i - clip_left + CASE WHEN i >= clip_left + m1 THEN del + skip - ins ELSE 0 END END AS site,
  CASE WHEN (k + i) % 53 = 0 THEN 4 ELSE (k * 31 + i * 17 + i * i + chrom) % 4 END AS base, 12 + (k * 7 + i * 3) % 30 AS qual, CASE WHEN kind <> 'S' THEN i - clip_left END AS off,
  CASE WHEN kind <> 'S' THEN CASE is_rev WHEN 1 THEN sequenced - 1 - (i - clip_left) ELSE i - clip_left END END AS d5,
  CASE WHEN kind <> 'S' THEN CASE WHEN flag & 2 > 0 AND is_rev = 1 THEN i - clip_left + fragment - sequenced WHEN flag & 2 > 0 THEN fragment - 1 - (i - clip_left)
    WHEN is_rev = 1 THEN i - clip_left ELSE sequenced - 1 - (i - clip_left) END END AS d3 FROM spots)"""

PILE = f"""{BASES}, pile0 AS (SELECT chrom, site, ref, count(*) AS depth, count_if(base = 0) AS na, count_if(base = 1) AS nc, count_if(base = 2) AS ng, count_if(base = 3) AS nt FROM bases GROUP BY ALL),
pile AS (SELECT *, CAST(na > 0 AS INT) + CAST(nc > 0 AS INT) + CAST(ng > 0 AS INT) + CAST(nt > 0 AS INT) AS n_alleles, [na, nc, ng, nt][ref + 1] AS ref_depth, depth - [na, nc, ng, nt][ref + 1] AS alt_depth FROM pile0)"""

_E = "pow(10.0, -qual / 10)"
_SUMS = ", ".join(f"sum(CASE WHEN base = {b} THEN {k} ELSE 0 END) AS {k}{b}" for k in ("one", "two") for b in range(4))
_LOGS = ", ".join(f"miss + two{a}" if a == b else f"miss + one{a} + one{b}" for a, b in GENOTYPES)
LIKELIHOODS = f"""{BASES}, terms AS (SELECT chrom, site, ref, base, ln({_E} / 3) AS m, ln((1 - {_E} + {_E} / 3) / 2) - ln({_E} / 3) AS one, ln(1 - {_E}) - ln({_E} / 3) AS two FROM bases),
sums AS (SELECT chrom, site, ref, count(*) AS depth, sum(m) AS miss, {_SUMS} FROM terms GROUP BY ALL),
logs AS (SELECT chrom, site, ref, depth, [{_LOGS}] AS logs FROM sums),
sites AS (SELECT *, list_transform(logs, lambda x: exp(x - list_max(logs))) AS gl FROM logs)"""

MERGED = """m0 AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions),
m1 AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM m0),
merged AS (SELECT chrom, min(start) AS start, max(stop) AS stop FROM m1 GROUP BY chrom, run)"""

REGIONS = """regions AS (SELECT 1 + o_custkey % 3 AS chrom, o_orderkey * 7 % 500 * 100 + o_orderkey % 13 AS start,
  o_orderkey * 7 % 500 * 100 + o_orderkey % 13 + 20 + o_custkey % 50 AS stop FROM orders)"""

ALLELES = """alleles0 AS (SELECT 1 + p_partkey % 3 AS chrom, (p_partkey * 29) % 50000 AS site, p_partkey % 4 AS known_ref, (p_partkey + 1 + p_size % 3) % 4 AS known_alt FROM part),
alleles AS (SELECT chrom, site, min(known_ref) AS known_ref, min(known_alt) AS known_alt FROM alleles0 GROUP BY ALL)"""

PAIRS = """mates AS (SELECT l_orderkey AS name, l_returnflag AS rg, 1 + l_orderkey % 3 AS chrom, (l_orderkey * 11) % 50000 + CASE WHEN l_linenumber = 2 THEN 15 + l_partkey % 60 ELSE 0 END AS pos,
  20 + CAST(floor(l_quantity) AS BIGINT) AS len, l_linenumber - 1 AS is_second FROM lineitem WHERE l_linenumber < 3),
pairs AS (SELECT name, rg, chrom, a.pos AS pos1, a.len AS len1, b.pos AS pos2, b.len AS len2, CASE WHEN abs(b.pos - a.pos) <= 2000 THEN 'pair' ELSE 'orphan' END AS status
  FROM (SELECT * FROM mates WHERE is_second = 0) a FULL JOIN (SELECT * FROM mates WHERE is_second = 1) b USING (name, rg, chrom))"""

GL = """c AS (SELECT 1 + l_partkey % 3 AS chrom, 100 + (l_partkey % 997) * 13 AS pos, l_suppkey % 12 AS sample,
  count_if((CAST(floor(l_quantity) AS BIGINT) + l_suppkey * (1 + l_partkey % 5)) % 10 < l_partkey % 7) AS a, count(*) AS dp FROM lineitem GROUP BY ALL),
g AS (SELECT *, least(20 * a, 3 * dp, 20 * (dp - a)) AS mn FROM c),
gl AS (SELECT chrom, pos, sample, sample % 3 AS pop, dp, a AS ad, 20 * a - mn AS pl0, 3 * dp - mn AS pl1, 20 * (dp - a) - mn AS pl2, CASE WHEN 20 * a = mn THEN 0 WHEN 3 * dp = mn THEN 1 ELSE 2 END AS gt FROM g)"""

#: The letters of a locus of gl.
LOCUS_REF, LOCUS_ALT = "substr('ACGT', CAST(pos % 4 + 1 AS INT), 1)", "substr('ACGT', CAST((pos + 1 + chrom % 3) % 4 + 1 AS INT), 1)"

NORMAL = f"""{GL}, raw AS (SELECT *, pow(10.0, -pl0 / 10) AS r0, pow(10.0, -pl1 / 10) AS r1, pow(10.0, -pl2 / 10) AS r2 FROM gl),
normal AS (SELECT chrom, pos, sample, pop, r0 / (r0 + r1 + r2) AS l0, r1 / (r0 + r1 + r2) AS l1, r2 / (r0 + r1 + r2) AS l2 FROM raw)"""


def draw(key: str, seed: int = 0) -> str:
    return f"(((({seed} * 48271 + {key} * 69621 + 12345) % 2147483647) * 16807) % 2147483647) / 2147483647.0"


def posterior(prior: list[float]) -> str:
    """gl times prior, normalised, as list post of view posts."""
    each = ", ".join(f"gl[{i + 1}] * {p!r}" for i, p in enumerate(prior))
    return f"{LIKELIHOODS}, weights AS (SELECT chrom, site, ref, [{each}] AS w FROM sites), posts AS (SELECT chrom, site, ref, list_transform(w, lambda x: x / list_sum(w)) AS post FROM weights)"


def mutation_load(steps: int) -> str:
    def of(c: int) -> str:
        kind = lambda r, a, b: 0 if a == b == r else 1 if r in (a, b) else 2 if a == b else 3
        when = " ".join(f"WHEN {r} THEN ({' + '.join(f'gl[{i + 1}]' for i, (a, b) in enumerate(GENOTYPES) if kind(r, a, b) == c)}) / {1 if c == 0 else 3}.0" for r in range(4))
        return f"CASE ref {when} END AS c{c}"

    text = f"WITH {LIKELIHOODS}, k AS (SELECT {', '.join(map(of, range(4)))} FROM sites), p0 AS (SELECT 0.25 AS p0, 0.25 AS p1, 0.25 AS p2, 0.25 AS p3)"
    total = " + ".join(f"c{c} * p{c}" for c in range(4))
    for t in range(steps):
        sums = ", ".join(f"sum(c{c} * p{c} / ({total})) AS s{c}" for c in range(4))
        text += f", q{t} AS (SELECT {sums} FROM k, p{t}), p{t + 1} AS (SELECT {', '.join(f's{c} / (s0 + s1 + s2 + s3) AS p{c}' for c in range(4))} FROM q{t})"
    return text + " " + " UNION ALL ".join(f"SELECT {c} AS class, round(p{c}, 6) AS weight FROM p{steps}" for c in range(4))


def hw_em(steps: int) -> str:
    text, before = f"WITH {NORMAL}, f0 AS (SELECT DISTINCT chrom, pos, pop, CAST(0.5 AS DOUBLE) AS f FROM normal)", "f0"
    for t in range(1, steps + 1):
        w = "l1 * 2 * f * (1 - f) + 2 * l2 * f * f", "l0 * (1 - f) * (1 - f) + l1 * 2 * f * (1 - f) + l2 * f * f"
        text += f", f{t} AS (SELECT chrom, pos, pop, sum(({w[0]}) / ({w[1]})) / (2 * count(*)) AS f FROM normal JOIN {before} USING (chrom, pos, pop) GROUP BY ALL)"
        before = f"f{t}"
    return text + f" SELECT chrom, pos, pop, round(f, 6) AS freq FROM {before}"


HWE = f"""WITH {GL}, counts AS (SELECT chrom, pos, pop, count(*) AS n, CAST(2 * count(*) - sum(gt) AS BIGINT) AS n_a, count_if(gt = 1) AS n_ab FROM gl GROUP BY ALL),
cases AS (SELECT DISTINCT n, n_a, n_ab, 2 * n - n_a AS b FROM counts),
h AS (SELECT *, unnest(range(0, least(n_a, b) + 1)) AS h FROM cases),
p AS (SELECT n, n_a, n_ab, h, exp(h * ln(2.0) + lgamma(n + 1) + lgamma(n_a + 1) + lgamma(b + 1) - lgamma(2 * n + 1) - lgamma((n_a - h) // 2 + 1) - lgamma(h + 1) - lgamma((b - h) // 2 + 1)) AS p FROM h WHERE (h - n_a) % 2 = 0),
s AS (SELECT n, n_a, n_ab, round(sum(CASE WHEN h <= n_ab THEN p ELSE 0 END), 6) AS p_less, round(sum(CASE WHEN h >= n_ab THEN p ELSE 0 END), 6) AS p_more FROM p GROUP BY ALL)
SELECT chrom, pos, pop, n, n_a, n_ab, p_less, p_more FROM counts JOIN s USING (n, n_a, n_ab)"""

_PSI = "(0.2 * exp(-0.3 * off) + 0.01)"
_LIKE = [f"CASE WHEN base = {b} THEN 1 - {_E} ELSE {_E} / 3 END" for b in range(4)]
_PRIOR = [f"CASE WHEN ref = {b} THEN 0.999 ELSE 0.001 / 3 END" for b in range(4)]
_PLAIN = " + ".join(f"({_LIKE[b]}) * ({_PRIOR[b]})" for b in range(4))
_DAMAGED = " + ".join(f"({f'(1 - {_PSI}) * ({_LIKE[1]}) + {_PSI} * ({_LIKE[3]})' if b == 1 else _LIKE[b]}) * ({_PRIOR[b]})" for b in range(4))
PMDS_CTE = f"{BASES}, scores AS (SELECT read_id, sum(ln(({_DAMAGED}) / ({_PLAIN}))) AS s FROM bases GROUP BY read_id)"
PMDS = f"WITH {PMDS_CTE} SELECT read_id, round(s, 6) AS ds FROM scores"
