"""The catalogue of queries, and SQL with the same rows."""


def catalogue() -> dict:
    from folioscan.plans import more, queries, stored

    assert more and stored
    return queries.queries()


def sql() -> dict[str, str]:
    from folioscan.plans import more, queries, stored

    assert more and stored
    return queries.oracle_sql()
