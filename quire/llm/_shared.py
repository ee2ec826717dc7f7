"""Tables in the shared folder, as the rest of the library keeps them."""

from __future__ import annotations

from ..store import new_folder, remove, shared_dir, written

__all__ = ["new_folder", "remove", "shared_dir", "written"]
