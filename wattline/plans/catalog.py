"""Importing this module fills the registry."""

from wattline.plans import (  # noqa: F401
    flow_queries,
    model_queries,
    network_queries,
    procedure_queries,
    readings_queries,
    relation_queries,
    spatial_queries,
)
from wattline.plans.registry import CHECKS, QUERIES, runner  # noqa: F401
