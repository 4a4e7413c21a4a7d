"""The library's shared tables and size checks, by the names that the operators here use."""

from siftwork.sources.shared import BROADCAST_BYTES, BROADCAST_ROWS, fresh, new_folder, shared_folder, small_side, spill

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "fresh", "new_folder", "shared_folder", "small_side", "spill"]
