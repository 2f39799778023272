"""Registered queries over the test tables, one module per area."""

from rastermill.queries import catalog, chunks, flow, network, raster, stats, streams  # noqa: F401
