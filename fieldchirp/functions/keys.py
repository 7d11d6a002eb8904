"""File keys: the one join key that most tables share."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_key(col) -> Column:
    """Trim blanks at both ends and collapse repeated slashes; letter case counts.

    Null stays null; a key that is blank throughout becomes null, as it names no file.
    """
    c = F.col(col) if isinstance(col, str) else col
    c = F.btrim(c, F.lit(" \t\r\n"))
    # The pattern runs only where it has work to do: it is many times dearer than the search for two slashes.
    return F.when(F.contains(c, F.lit("//")), F.regexp_replace(c, r"/{2,}", "/")).when(c != "", c)


def nan_to_null(col) -> Column:
    """NaN and null both mean 'not known'; everything past ingest sees null only."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def parent_folder(path) -> Column:
    """Name of the folder that holds the file; null for a bare file name."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2)))


def second_parent(path) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(-3)))


def two_parents(path) -> Column:
    """``grandparent/parent`` of the file."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2))))


def filename_first_part(path) -> Column:
    """File name up to its first underscore."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), "_", 1)
