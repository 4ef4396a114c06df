from .tables import table, TABLES  # noqa: F401
