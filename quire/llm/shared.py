"""The folder that the driver and all executors share, as the engine has it."""

from quire.sources.shared import delete, drop, exists, file_system, new_path, root, scratch, written

__all__ = ["delete", "drop", "exists", "file_system", "new_path", "root", "scratch", "written"]
