"""Windowed analytics over integer-indexed cubes, as plain Spark plans.

A cube is a DataFrame with integer dimension columns and value columns. Every operator
returns a lazy DataFrame or cube, so that Catalyst and adaptive execution plan the work.
"""

from importlib import import_module

#: The names that are offered here, by module. They are imported when they are first used, so
#: that a Python worker that needs one module of the package doesn't load all of them.
_PLACES = {
    "cube": ("Cube",),
    "functions.stats": ("stat",),
    "functions.userfunc": ("create_function",),
    "operators.aggregate": ("aggregate", "count_map", "mapreduce", "mapslices", "median", "zonal"),
    "operators.maps": ("broadcast", "map_cells"),
    "operators.moving": ("rolling", "windowed"),
    "operators.resample": ("Axis", "interpolate", "pyramid"),
    "operators.windowed": ("InputArray", "OutWindows", "windowed_op"),
    "operators.windows": ("Formula", "InTable", "Labels", "Points", "Ranges", "Regular", "Repeated", "Sliding", "Tumbling", "Whole"),
    "sources.layout": ("copy_to", "planned_chunks", "rechunk", "run_blocks", "write_cube"),
}
_MODULES = {name: module for module, names in _PLACES.items() for name in names}
__all__ = sorted(_MODULES)


def __getattr__(name: str):
    if name not in _MODULES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_MODULES[name]}", __name__), name)
