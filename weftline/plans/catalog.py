"""Imports every module of core queries, so that the registry is filled; landed and inventory build on the others."""

from weftline.plans import extensions, hierarchies, retrieval, serving, terms  # noqa: F401, I001
from weftline.plans import landed  # noqa: F401
from weftline.plans import inventory  # noqa: F401
from weftline.plans.registry import core

__all__ = ["core"]
