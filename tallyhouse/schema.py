"""Table schemas and the fixed values the operators share."""

from pyspark.sql import types as T

SCHEMA_VERSION = 1

ENTRY_FIELDS = [
    T.StructField("path", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("ext", T.StringType(), True),
    T.StructField("size", T.LongType(), False),
    T.StructField("physical_size", T.LongType(), True),
    T.StructField("mtime", T.LongType(), True),
    T.StructField("is_dir", T.BooleanType(), False),
    T.StructField("depth", T.IntegerType(), False),
]

#: One row per entry of a snapshot; `snapshot_id` is the partition column.
FILES = T.StructType([*ENTRY_FIELDS, T.StructField("snapshot_id", T.StringType(), False)])

#: What a listing export must carry; everything else is derived from it.
MANIFEST = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), True),
        T.StructField("physical_size", T.LongType(), True),
        T.StructField("mtime", T.LongType(), True),
        T.StructField("is_dir", T.BooleanType(), True),
    ]
)

#: One row per snapshot.
SCAN_META = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType(), False),
        T.StructField("root", T.StringType(), False),
        T.StructField("started_at", T.LongType(), False),
        T.StructField("ended_at", T.LongType(), True),
        T.StructField("completed", T.BooleanType(), False),
        T.StructField("entries", T.LongType(), False),
        T.StructField("bytes", T.LongType(), False),
    ]
)

#: What a store knows of a snapshot: the scan and the data files it takes.
STORED_META = T.StructType(
    [
        *SCAN_META.fields,
        T.StructField("stored_bytes", T.LongType(), True),
        T.StructField("stored_files", T.LongType(), True),
    ]
)

#: Bytes and files lying directly in one directory of one snapshot.
USAGE = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType(), False),
        T.StructField("dir", T.StringType(), False),
        T.StructField("files", T.LongType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("physical_bytes", T.LongType(), False),
    ]
)

TREE = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("depth", T.IntegerType()),
        *(
            T.StructField(name, T.LongType(), False)
            for name in ("pre", "last", "own_files", "own_bytes", "own_physical_bytes", "files", "bytes", "physical_bytes")
        ),
    ]
)

SECONDS_PER_DAY = 86400

# --- Fixed values ---------------------------------------------------------
# Results depend on these, so they are stated as plain text in one place.

#: 2000-01-01 UTC; older mtimes are build-tool placeholders, not history.
MTIME_FLOOR = 946684800

#: Last and first second that still has a printable date.
LAST_DATED_SECOND = 8210266876799
FIRST_DATED_SECOND = -8334601228800

#: Directory names that count as reclaimable, by category.
CLEANUP_CATEGORIES = {
    "node_modules": ("node_modules",),
    "target": ("target",),
    "pycache": ("__pycache__",),
    "next": (".next",),
    "dist": ("dist",),
    "build": ("build",),
    "venv": (".venv", "venv"),
    "gradle": (".gradle",),
    "pytest": (".pytest_cache",),
}

#: A path holding one of these is never a cleanup candidate.
PROTECTED_SUBSTRINGS = (
    "/.cargo/registry/",
    "/.cargo/git/",
    "/.rustup/",
    "/.npm/",
    "/.pnpm-store/",
    "/.yarn/cache/",
    "/site-packages/",
    "/.cache/pip/",
    "/.cache/uv/",
    "/Library/Caches/",
    "/Library/Group Containers/",
    "/Library/Application Support/",
    "/.vscode/extensions/",
    "/.windsurf/extensions/",
    "/.antigravity/",
)

#: Names skipped when no ignore list is given.
DEFAULT_IGNORES = (
    "node_modules",
    "target",
    "__pycache__",
    ".next",
    "dist",
    "build",
    ".venv",
    "venv",
    ".gradle",
    ".pytest_cache",
)

#: Seconds per duration unit.
DURATION_UNITS = {
    "s": 1,
    "m": 60,
    "h": 3600,
    "d": 86400,
    "w": 7 * 86400,
    "mo": 30 * 86400,
    "y": 365 * 86400,
}

#: Bytes per size unit; decimal names are binary too.
SIZE_UNITS = {
    "B": 1,
    "KB": 1024,
    "KIB": 1024,
    "MB": 1024**2,
    "MIB": 1024**2,
    "GB": 1024**3,
    "GIB": 1024**3,
    "TB": 1024**4,
    "TIB": 1024**4,
}

#: Growth-shape thresholds.
DECLINING_SLOPE_SHARE = -0.01
DECLINING_R2 = 0.5
SPIKE_RATIO = 4.0
STABLE_RATIO = 3.0
EARLY_SPIKE_DIVISOR = 3
MIN_SHAPE_SAMPLES = 3
