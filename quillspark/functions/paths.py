"""Path and repository-address functions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a scan leaves out.
SKIP_DIRS = [
    ".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".next", ".svelte-kit", "coverage", ".cache", ".turbo", ".output", "target", "out", ".idea", ".vscode", ".pytest_cache", ".mypy_cache", ".tox", "venv", ".venv", "env",
    ".nuxt", ".expo", ".angular", ".parcel-cache", ".docusaurus", ".nx", "_site", "_build", "CMakeFiles", "obj", ".pnpm-store", ".bundle", "Pods", ".svn", ".hg", ".gradle", ".mvn", ".dart_tool", ".pub-cache", ".zig-cache", ".ruff_cache",
    ".terraform", ".serverless", ".vs", ".eclipse", ".settings", "tmp", "temp", "logs", "log", ".coverage", "DerivedData", "third_party", "3rdparty",
]
SKIP_EXTENSIONS = [
    ".lock", ".min.js", ".min.css", ".map", ".wasm", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".wav", ".ogg", ".pdf", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".pyc", ".pyo", ".class", ".jar", ".war", ".ttf", ".woff", ".woff2", ".eot", ".otf",
    ".tsbuildinfo", ".swp", ".swo", ".bak", ".tmp", ".orig", ".log", ".db", ".sqlite", ".sqlite3", ".tgz", ".xz", ".zst", ".bmp", ".tif", ".tiff", ".avif", ".heic", ".psd", ".ai", ".sketch", ".fig", ".mov", ".mkv", ".webm", ".flac", ".aac", ".node", ".bin", ".dat", ".whl", ".egg",
    ".parquet", ".arrow", ".h5", ".hdf5", ".pkl", ".pickle", ".onnx", ".pt", ".pth", ".safetensors", ".dmg", ".iso", ".msi", ".deb", ".rpm",
]
SKIP_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", ".DS_Store", "Thumbs.db", ".env", ".env.local", ".env.development", ".env.production", ".env.staging", ".env.test", "credentials.json", "service-account.json", ".npmrc", ".pypirc", ".netrc", "id_rsa", "id_ed25519", ".htpasswd",
    "uv.lock", "go.sum", "Pipfile.lock", "flake.lock", ".terraform.lock.hcl", "desktop.ini",
]
# Languages by extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss", ".less": "less", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".md": "markdown", ".mdx": "markdown", ".svelte": "svelte", ".vue": "vue",
}
# First path segments that sort first, and limits of a scan.
PRIORITY_DIRS = ["src", "lib", "app", "pkg", "cmd", "internal"]
MAX_FILE_BYTES, MAX_FILES, SNIFF_BYTES = 1_048_576, 10_000, 8_192
# What counts as a path in page text.
CITED_EXTENSIONS = [
    "ts", "tsx", "js", "jsx", "mjs", "cjs", "svelte", "vue", "py", "go", "rs", "java", "kt", "swift", "rb", "php", "c", "h", "cpp", "hpp", "cs", "css", "scss", "less", "html", "sql", "json", "yaml", "yml", "toml", "xml", "md", "mdx", "sh", "bash", "zsh", "txt", "webmanifest",
]
NEVER_CITED_DIRS = ["build", "dist", "out", "node_modules", "data", "coverage", ".svelte-kit"]
NEVER_CITED_FILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "credentials.json", "service-account.json"]

#: All white space, Unicode's too.
_EDGE = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end; trim() takes off spaces alone."""
    return F.regexp_replace(c, _EDGE, "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Last extension with its dot, lower case; empty for names that begin with their only dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """The language of a path's extension, or null."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension(path))


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SKIP_DIRS)))


def scannable(path: Column, size: Column) -> Column:
    """What a scan keeps before it reads a file."""
    return ~in_skipped_dir(path) & ~base_name(path).isin(SKIP_FILES) & ~extension(path).isin(SKIP_EXTENSIONS) & size.between(1, MAX_FILE_BYTES)


def priority(path: Column) -> Column:
    return F.split(path, "/")[0].isin(PRIORITY_DIRS)


def is_doc(path: Column) -> Column:
    return path.rlike(r"(?i)\.(md|mdx|markdown|rst|txt)\z")


def is_readme(path: Column) -> Column:
    return base_name(path).rlike(r"(?i)\Areadme(\.\w+)?\z")


def is_local(address: Column) -> Column:
    return trimmed(address).rlike(r"\A(/|~|\./|\.\./)")


def valid_name(name: Column) -> Column:
    return name.rlike(r"\A[a-zA-Z0-9._-]+\z")


def valid_sha(sha: Column) -> Column:
    return sha.rlike(r"\A[0-9a-fA-F]{40}\z")


def repo_address(address: Column) -> Column:
    """owner, name and url of a repository address, or null: host and path, or owner/name alone."""
    clean = F.regexp_replace(F.regexp_replace(trimmed(address), r"\.git\z", ""), r"/\z", "")
    hosted = r"github\.com/([^/]+)/([^/]+)"
    short = r"\A([^/]+)/([^/]+)\z"
    at = F.when(clean.rlike(hosted), F.lit(hosted)).when(clean.rlike(short), F.lit(short))
    owner, name = F.regexp_extract(clean, hosted, 1), F.regexp_extract(clean, hosted, 2)
    owner = F.when(at == hosted, owner).otherwise(F.regexp_extract(clean, short, 1))
    name = F.when(at == hosted, name).otherwise(F.regexp_extract(clean, short, 2))
    url = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name)
    return F.when(at.isNotNull() & valid_name(owner) & valid_name(name), F.struct(owner.alias("owner"), name.alias("name"), url.alias("url")))


def hosted_repo(url: Column) -> Column:
    """owner/name of a full repository URL, or empty."""
    clean = F.regexp_replace(F.regexp_replace(trimmed(url), "/+$", ""), r"\.git$", "")
    return F.concat_ws("/", *[F.nullif(F.regexp_extract(clean, r"\Ahttps?://github\.com/([^/]+)/([^/]+)\z", i), F.lit("")) for i in (1, 2)])


def cited_path(raw: Column) -> Column:
    """A reference without ./, leading slashes and line numbers."""
    for pattern in (r"^\./", r"^/+", r"#L\d+(-L?\d+)?$", r":\d+(-\d+)?$"):
        raw = F.regexp_replace(raw, pattern, "")
    return raw


def is_cited_path(c: Column) -> Column:
    last = base_name(c)
    return (
        F.length(c).between(1, 200)
        & c.rlike(r"\A[\w@./-]+\z")
        & ~c.contains("//")
        & ~c.contains("..")
        & ~c.startswith(".")
        & ~F.split(c, "/")[0].isin(NEVER_CITED_DIRS)
        & ~last.isin(NEVER_CITED_FILES)
        & F.lower(F.regexp_extract(last, r"\A.+\.([^.]*)\z", 1)).isin(CITED_EXTENSIONS)
    )


def cited_paths(content: Column) -> Column:
    """Paths that code spans and links of a page's text refer to: distinct, sorted."""
    spans = F.transform(F.regexp_extract_all(content, F.lit(r"`([^`\n]+)`"), 1), lambda x: cited_path(trimmed(x)))
    blob = r"github\.com/[^/\s]+/[^/\s]+/blob/[^/\s]+/([^)\s#]+)"
    links = F.regexp_extract_all(content, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), 1)
    hrefs = F.transform(
        F.filter(links, lambda h: h.rlike(blob) | ~(h.rlike(r"\A(?i)[a-z]+://") | h.startswith("#"))),
        lambda h: cited_path(F.when(h.rlike(blob), F.regexp_extract(h, blob, 1)).otherwise(h)),
    )
    return F.sort_array(F.array_distinct(F.filter(F.concat(spans, hrefs), is_cited_path)))


def uri_component(c: Column) -> Column:
    """Percent-encoding of everything but A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for plain, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def page_path(owner: Column, repo: Column, slug: Column | None = None, version: Column | None = None) -> Column:
    out = F.concat(F.lit("/"), uri_component(owner), F.lit("/"), uri_component(repo))
    if slug is not None:
        out = F.concat(out, F.coalesce(F.concat(F.lit("/"), uri_component(F.nullif(slug, F.lit("")))), F.lit("")))
    if version is not None:
        out = F.concat(out, F.coalesce(F.concat(F.lit("?v="), uri_component(F.nullif(version.cast("string"), F.lit("")))), F.lit("")))
    return out
