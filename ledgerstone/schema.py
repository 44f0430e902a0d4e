"""The relations of the archive catalog."""

from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("archive_path", T.StringType(), False), T.StructField("index", T.LongType(), False), T.StructField("path", T.StringType(), False),
    T.StructField("components", T.ArrayType(T.StringType(), False), False), T.StructField("display_path", T.StringType(), False), T.StructField("size", T.LongType()),
    T.StructField("compressed_size", T.LongType()), T.StructField("modified_unix_seconds", T.LongType()), T.StructField("kind", T.StringType(), False), T.StructField("encrypted", T.BooleanType(), False),
])
ARCHIVE = T.StructType([
    T.StructField("archive_path", T.StringType(), False), T.StructField("format_name", T.StringType(), False), T.StructField("filter_name", T.StringType()), T.StructField("warning", T.StringType()),
    T.StructField("error_class", T.StringType()), T.StructField("error_detail", T.StringType()), T.StructField("entry_count", T.LongType()), T.StructField("total_uncompressed_size", T.LongType()),
])
KINDS = ("File", "Directory", "Symlink", "Hardlink", "Other")
PHASES = ("Opening", "Listing", "Extracting", "Compressing", "Testing", "Finished")
#: The limits of a listing and of an extraction.
MAX_ENTRIES, MAX_PATH_BYTES, MAX_LISTED_BYTES = 1_000_000, 256 << 20, 512 << 40
MAX_EXTRACT_BYTES, MAX_FILE_BYTES = 512 << 30, 128 << 30
