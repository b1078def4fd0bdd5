"""The registry of queries and their SQL, filled by the modules of this package."""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WIN = 5000
THETA = 0.001


def query(text: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return keep
