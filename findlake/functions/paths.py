"""Column expressions over '/'-separated paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must match the reference's behaviour -------------------
# An item is skipped during indexing when its lower-cased parent path contains
# any of these substrings (a substring test, not a path-component test).
SKIP_DIRECTORIES = ("system32", "windows", "programdata", "$recycle", "appdata",
                    ".git", "node_modules", "__pycache__")
# Score bonus is given when the parent's own name contains one of these.
COMMON_FOLDERS = ("documents", "desktop", "downloads")
# Display labels of an item type.
FOLDER_LABEL = "\U0001F4C1 Folder"
FILE_LABEL = "\U0001F4C4 File"
# -----------------------------------------------------------------------------

SKIP_RE = "|".join(re.escape(s) for s in SKIP_DIRECTORIES)
COMMON_RE = "|".join(re.escape(s) for s in COMMON_FOLDERS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_path(p) -> Column:
    """'\\' and repeated '/' become one '/'; a trailing '/' is dropped except at a drive root.

    Every path expression here reads its input once: Catalyst inlines these
    into each other and into pushed-down filters, and repeated references
    would multiply the generated code.
    """
    collapsed = F.regexp_replace(_col(p), r"[\\/]+", "/")
    return F.regexp_replace(collapsed, r"(?s)^(.*[^:/])/$", "$1")


def name_of(path) -> Column:
    """Last path component."""
    return F.substring_index(_col(path), "/", -1)


def suffix_of(name) -> Column:
    """Lower-cased suffix with its dot; '' for '.bashrc', 'foo.' and no dot."""
    return F.regexp_extract(F.lower(_col(name)), r"(?s)^.+(\.[^.]+)$", 1)


def parent_of(path) -> Column:
    """Path without its last component; 'D:/x' -> 'D:/', '/x' -> '/', 'x' -> ''."""
    return F.regexp_replace(_col(path), r"(?s)^([A-Za-z]:/|/)?(?:(.*)/)?[^/]*$", "$1$2")


def parent_name_of_path(path) -> Column:
    """Own name of the parent folder; '' at a drive root or when there is no parent."""
    return F.regexp_extract(_col(path), r"(?s)^(?![A-Za-z]:/[^/]*$)(?:.*/)?([^/]+)/[^/]*$", 1)


def parent_name_of(parent) -> Column:
    """The last component of a parent path; '' for a drive root, '/' or ''."""
    return F.regexp_extract(_col(parent), r"(?s)^(?![A-Za-z]:/?$)(?:.*/)?([^/]+)$", 1)


def drive_of(path) -> Column:
    """Upper-cased drive letter, '' for paths without one."""
    return F.upper(F.regexp_extract(_col(path), r"^([A-Za-z]):", 1))


def drive_path(letter) -> Column:
    """'c' -> 'C:/'."""
    return F.concat(F.upper(_col(letter)), F.lit(":/"))


def item_type(is_dir) -> Column:
    return F.when(_col(is_dir), F.lit("folder")).otherwise(F.lit("file"))


def item_label(is_dir) -> Column:
    return F.when(_col(is_dir), F.lit(FOLDER_LABEL)).otherwise(F.lit(FILE_LABEL))


def in_system_dir(parent) -> Column:
    """True when the lower-cased parent path contains a skipped substring."""
    return F.lower(_col(parent)).rlike(SKIP_RE)


def under_system_dir(path) -> Column:
    """Same test as ``in_system_dir(parent_of(path))`` without computing the parent.

    The skipped substrings hold no '/', so one lies inside the parent exactly
    when a '/' follows it in the path.
    """
    return F.lower(_col(path)).rlike("(?s)(?:" + SKIP_RE + ").*/")


def in_common_folder(parent_name) -> Column:
    return F.lower(_col(parent_name)).rlike(COMMON_RE)
