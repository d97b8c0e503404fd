"""Operators bound to the driver tables, one module per family."""

import importlib
import pkgutil


def load() -> None:
    """Import every binding module so that it registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
