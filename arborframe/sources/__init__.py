"""Where frames come from and where they are kept."""

from arborframe.sources.catalog import Database, FolderDatabase
from arborframe.sources.readers import bits_of_mask, from_arrays, from_arrow, from_npy, fromdata, group_by_prefix, mask_of_bits, nest, to_json, with_position, write_npy

__all__ = ["Database", "FolderDatabase", "bits_of_mask", "from_arrays", "from_arrow", "from_npy", "fromdata", "group_by_prefix", "mask_of_bits", "nest", "to_json", "with_position", "write_npy"]
