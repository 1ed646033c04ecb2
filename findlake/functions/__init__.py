"""Column-level building blocks (all built-in Spark expressions)."""

from findlake.functions.paths import (COMMON_FOLDERS, SKIP_DIRECTORIES, drive_of, drive_path,
                                      in_common_folder, in_system_dir, item_label, item_type,
                                      name_of, normalise_path, parent_name_of, parent_of,
                                      suffix_of)
from findlake.functions.text import (MIN_WORD_LENGTH, case_fold, is_blank, is_safe_name,
                                     normalise_query, strip_ws, tokenise_name, tokenise_query,
                                     unsafe_name_reason)

__all__ = [
    "COMMON_FOLDERS", "SKIP_DIRECTORIES", "MIN_WORD_LENGTH",
    "case_fold", "drive_of", "drive_path", "in_common_folder", "in_system_dir", "is_blank",
    "is_safe_name", "item_label", "item_type", "name_of", "normalise_path", "normalise_query",
    "parent_name_of", "parent_of", "strip_ws", "suffix_of", "tokenise_name", "tokenise_query",
    "unsafe_name_reason",
]
