"""All queries of the core library."""

from wayledger.plans import annotation, files, pipeline, relational, scalar, shapes, spatial, structure, tracks
from wayledger.plans.registry import Catalog

CATALOG = Catalog().merge(pipeline.CATALOG, relational.CATALOG, annotation.CATALOG, tracks.CATALOG, shapes.CATALOG, scalar.CATALOG, structure.CATALOG, files.CATALOG, spatial.CATALOG)
