"""Registered queries and the SQL that says the same."""


def load():
    """The registry with all queries."""
    from quire.plans import event_queries, flagship, media_queries, registry, section_queries, segment_queries, source_queries, stream_queries, text_queries, voice_queries  # noqa: F401

    return registry
