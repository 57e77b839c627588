"""Analytics on dense labelled 3D images with PySpark.

Names are imported when they are first used, so a Python worker loads only the modules that its functions come from.
"""

from importlib import import_module

_MODULES = {
    "operators.aggregates": "as_runs bounding_boxes centroids label_stats pixel_pairs runs voxel_counts",
    "operators.components": "component_counts component_table connected_components graph_components layer_components slice_components",
    "operators.contours": "contours",
    "operators.neighbourhood": "contacts mode_pooling point_cloud voxel_connectivity_graph",
    "operators.pins": "pins",
    "operators.relabel": "add_scalar ascontiguousarray asfortranarray astype floordiv_scalar mask mask_except multiply_scalar operator refit remap renumber subtract_scalar truediv_scalar",
    "operators.selection": "assign binary_image contains contains_range cutout each each_multi index_range labels labels_for_z_range min_max num_labels z_range_for_label z_slab",
    "operators.structure": "array_equal differences structure_equal zshatter zsplit zstack",
    "sources.files": "aload bload check_streams load load_any load_header load_num_labels load_numpy read_blocks read_runs read_sidecar read_streams read_table save save_numpy write_blocks write_runs write_sidecar write_table",
    "sources.remote": "rload",
    "sources.stream": "block_table check compress decompress from_blocks ok recompress reencode",
    "volume": "FormatError LabelError LabelVolume from_runs from_table full ones zeros",
}
_HOME = {name: module for module, names in _MODULES.items() for name in names.split()}
__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME[name]}", __name__), name)


def __dir__() -> list[str]:
    return __all__
