"""Schemas and fixed values of the file catalog."""

from __future__ import annotations

from pyspark.sql import types as T

#: What a source must supply: one row a path; sizes in bytes, times in whole epoch seconds.
ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime", T.LongType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
    ]
)

#: What a walk can add of each entry.
DETAILS = T.StructType(
    [
        *ENTRY.fields,
        T.StructField("created", T.LongType()),
        T.StructField("owner", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("permissions", T.IntegerType()),
        T.StructField("inode", T.LongType()),
        T.StructField("links", T.LongType()),
    ]
)

#: The catalog: an entry with what is derived from its path once, at ingest.
FILES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        *ENTRY.fields,
        T.StructField("name", T.StringType(), False),
        T.StructField("dir", T.StringType(), False),
        T.StructField("ext", T.StringType(), False),
        T.StructField("name_ext", T.StringType(), False),
        T.StructField("is_hidden", T.BooleanType(), False),
        T.StructField("parent_name", T.StringType(), False),
        T.StructField("ancestors", T.ArrayType(T.StringType(), False), False),
    ]
)

#: A change: `op` is upsert or remove (of a whole subtree); `seq` orders changes.
DELTA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("seq", T.LongType(), False),
    ]
)

#: A file-system event as it arrives.
EVENT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("seq", T.LongType()),
    ]
)

SCHEMA_VERSION = 3

# Extensions of each category, archive and document types, limits and file-system types.
CATEGORY_EXTENSIONS = {
    "Images": "png jpg jpeg gif webp svg bmp tiff ico".split(),
    "Docs": "pdf doc docx odt rtf txt md log csv xls xlsx ods ppt pptx odp epub tex".split(),
    "Code": "rs py js ts go c cpp h hpp java rb sh toml json yaml yml html css sql php lua zig ex exs kt swift v nix ps1 bat".split(),
    "Archives": "zip tar gz xz bz2 7z rar zst deb rpm".split(),
    "Audio": "mp3 wav flac ogg m4a aac opus mid".split(),
    "Video": "mp4 mkv avi mov webm flv mpg mpeg wmv".split(),
}
ARCHIVE_NAMES = "zip tar gz tgz xz bz2 7z rar zst deb rpm jar war apk cbz".split()
ZIP_ARCHIVES = "zip jar war apk cbz".split()
DOCUMENT_EXTENSIONS = "docx odt ods odp odg pdf".split()
DEFAULT_LIMIT, CLI_LIMIT, CANDIDATE_CAP, COMPACT_AT, CONTENT_MIN = 1000, 100, 50_000, 20_000, 3
ARCHIVE_LIST_MAX, TAR_MEMBERS_MAX = 5000, 20_000
TEXT_MAX, CACHE_MAX, ARCHIVE_MAX, MEMBER_MAX, PROBE = 8 << 20, 256 << 20, 64 << 20, 16 << 20, 8192
NETWORK_FSTYPES = "nfs nfs4 smbfs cifs sshfs fuse.sshfs fuse.rclone fuse.s3fs fuse.smb 9p".split()
EXCLUDED_FSTYPES = (
    "proc sysfs devpts devtmpfs securityfs debugfs tracefs pstore bpf cgroup cgroup2 mqueue hugetlbfs configfs fusectl efivarfs ramfs "
    "binfmt_misc rpc_pipefs autofs overlay squashfs iso9660 nfs nfs4 smbfs cifs sshfs fuse.sshfs fuse.rclone fuse.s3fs fuse.smb gvfsd-fuse 9p"
).split()
EXCLUDED_NAMES = (
    ".venv venv env .env virtualenv __pycache__ __pypackages__ .eggs .pytest_cache .mypy_cache .ruff_cache .tox .nox .ipynb_checkpoints "
    "node_modules .npm .yarn .pnpm-store .bun .next .nuxt .svelte-kit .turbo .parcel-cache .vite .angular bower_components "
    "go/pkg/mod pkg/mod go-build target .gradle .m2 .ivy2 .kotlin .bloop .metals .sbt dist-newstyle .stack-work "
    ".bundle vendor/bundle deps _build .dart_tool .pub-cache .swiftpm Pods obj"
).split()
#: Unix times and sizes by word.
AGE_WORDS = {"today": 86_400, "yesterday": 172_800, "week": 604_800, "thisweek": 604_800, "month": 2_592_000, "year": 31_536_000}
#: Fuzzy weights: a character, one next to the last, the most a gap or the length costs, one at a word's start.
FUZZY_CHAR, FUZZY_NEXT, FUZZY_GAP_MAX, FUZZY_START, FUZZY_LENGTH_MAX = 16, 6, 12, 8, 16
WORD_BREAKS = "/\\._- ([,"
