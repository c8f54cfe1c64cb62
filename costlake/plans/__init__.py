"""The registered queries: each operator over whole tables, with the SQL that must agree with it."""


def registered():
    """(queries, twins) of every query module."""
    from costlake.plans import catalog, cost_queries, intake_queries, metric_queries, series_queries, stream_queries

    del cost_queries, intake_queries, metric_queries, series_queries, stream_queries  # imported to register
    return dict(catalog.QUERIES), dict(catalog.ORACLES)
