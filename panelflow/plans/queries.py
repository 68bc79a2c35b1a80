"""All query modules, so that importing this one fills the registry."""

from . import answer_queries, font_queries, layout_queries, page_queries, raster_queries, reading_queries, shape_queries, source_queries, status_queries, text_queries  # noqa: F401
