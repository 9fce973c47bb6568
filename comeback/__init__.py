"""Product-usage retention analytics expressed as Spark DataFrame jobs."""

from comeback.config import Settings, Taxonomy
from comeback.plans.workspace import Workspace

__all__ = ["Settings", "Taxonomy", "Workspace"]
