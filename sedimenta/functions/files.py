"""Which files are worth indexing, as Column expressions over paths and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders, names, extensions and name endings that are left out.
SKIP_DIRS = (
    "node_modules vendor third_party dist build out target .next .nuxt __pycache__ .venv venv coverage .idea .vscode "
    "bower_components Pods .gradle .terraform"
).split()
SKIP_NAMES = (
    "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock uv.lock Cargo.lock Gemfile.lock composer.lock go.sum "
    "Pipfile.lock bun.lockb"
).split()
BINARY_EXTENSIONS = (
    "png jpg jpeg gif ico webp bmp tiff psd pdf zip gz tgz bz2 xz 7z rar jar war class so dylib dll exe bin o a wasm woff "
    "woff2 ttf otf eot mp3 mp4 mov avi webm wav ogg flac pyc db sqlite parquet pkl npy npz onnx pt h5 ckpt safetensors"
).split()
SKIP_ENDINGS = (".min.js", ".min.css", ".map", ".snap", ".svg")
MAX_MEAN_LINE = 400
MAX_BYTES = 400_000

#: Extension to language; ".txt" has none.
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go",
    "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp",
    "kt": "kotlin", "php": "php", "swift": "swift", "md": "markdown", "json": "json", "toml": "toml", "yaml": "yaml",
    "yml": "yaml", "sql": "sql", "sh": "bash", "html": "html", "css": "css",
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case ending after the last dot of a name that doesn't start there, else empty."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def normal_path(path: Column) -> Column:
    """A path without "." and empty segments, ".." taking the segment before it; "." if nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(acc, s):
        up = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    # most paths have no such segment, and a function of arrays takes some twenty times as long as these
    whole = F.concat(F.lit("/"), path, F.lit("/"))
    plain = ~(F.contains(whole, F.lit("//")) | F.contains(whole, F.lit("/./")) | F.contains(whole, F.lit("/../")))
    return F.when(plain, path).when(out == "", ".").otherwise(out)


def indexable_path(path: Column) -> Column:
    folders = F.split(dirname(path), "/")
    name = basename(path)
    skipped = F.exists(folders, lambda d: d.isin(*SKIP_DIRS) | d.startswith(".git"))
    ending = F.lower(name).rlike("(" + "|".join(e.replace(".", r"\.") for e in SKIP_ENDINGS) + ")$")
    return ~(skipped | name.isin(*SKIP_NAMES) | extension(path).isin(*BINARY_EXTENSIONS) | ending)


def decoded(data: Column) -> Column:
    """Text of bytes: UTF-8, else Latin-1; null if there is a zero byte or lines have over 400 characters on average."""
    text = F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))
    lines = F.size(F.split(F.regexp_replace(text, r"(\r\n|[\n\r])$", ""), r"\r\n|[\n\r]"))
    binary = F.position(F.lit("00"), F.regexp_replace(F.hex(data), "(..)", "$1 ")) > 0
    return F.when(~binary & ((F.length(text) == 0) | (F.length(text) / lines <= MAX_MEAN_LINE)), text)


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))
