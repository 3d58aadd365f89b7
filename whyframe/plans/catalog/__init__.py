"""Every operator as a query over the shared tables, beside the SQL that checks it."""

from whyframe.plans.catalog import (  # noqa: F401
    aggregates,
    explainers,
    frames,
    models,
    parsing,
    projections,
    quality,
    roundtrips,
    selection,
    similarity,
    sources,
)
