"""URL expressions. Relative links are resolved by a vectorised Python function, everything else stays in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Extensions of files that are no pages.
SKIP_EXTENSIONS = (".pdf", ".zip", ".tar", ".gz", ".jar", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot")
# Parts of an address that rule a page out, always and unless API pages are wanted.
SKIP_ALWAYS = (r"github\.com", r"stackoverflow\.com", r"mailto:")
SKIP_REFERENCE = ("/api/", "/javadoc/", "/javadoc-api/")

_PARTS = r"^(https?)://([^/?#]*)([^?#;]*)"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def normalize_url(url: Column) -> Column:
    """An absolute URL without parameters, query and fragment, with a slash after a last segment that has no dot.

    Null, empty, fragment-only and non-HTTP addresses give ''.
    """
    scheme, host, path = (F.regexp_extract(url, _PARTS, i) for i in (1, 2, 3))
    bare = F.concat(scheme, F.lit("://"), host, path)
    last = F.element_at(F.split(path, "/"), -1)
    folder = (path != "") & ~path.endswith("/") & ~last.contains(".")
    full = F.when(folder, F.concat(bare, F.lit("/"))).otherwise(bare)
    return F.when(url.isNull() | (scheme == ""), F.lit("")).otherwise(full)


@F.pandas_udf(StringType())
def resolve_url(url: pd.Series, base: pd.Series) -> pd.Series:
    """Relative links joined to their page's address; nulls give null."""
    from urllib.parse import urljoin

    return pd.Series([None if u is None or b is None else u if u.startswith(("http://", "https://")) else urljoin(b, u) for u, b in zip(url, base)])


def base_path(url: Column) -> Column:
    """The folder of an entry page: its address up to the last slash of the path, or with one added."""
    scheme, host, path = (F.regexp_extract(url, r"^(https?)://([^/?#]*)([^?#]*)", i) for i in (1, 2, 3))
    last = F.element_at(F.split(path, "/"), -1)
    folder = F.when(path == "", path).when(last.contains("."), F.regexp_replace(path, r"[^/]*$", "")).when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return F.concat(scheme, F.lit("://"), host, folder)


def skip_url(url: Column, content_type: Column | None = None) -> Column:
    """Whether a link leads to no page of the documentation; API pages are skipped unless content_type is api-doc."""
    path = F.lower(url_path(url))
    ends = "|".join(e.replace(".", r"\.") for e in SKIP_EXTENSIONS)
    skip = path.rlike(f"(?:{ends})$") | url.rlike("|".join(SKIP_ALWAYS))
    api = url.rlike("|".join(SKIP_REFERENCE))
    return F.coalesce(url == "", F.lit(True)) | skip | (api & (F.lit(True) if content_type is None else ~content_type.eqNullSafe(F.lit("api-doc"))))


def is_internal(url: Column, base: Column) -> Column:
    return F.coalesce((url != "") & (base != "") & url.startswith(base), F.lit(False))


def object_key(module: Column, submodule: Column, version: Column, url: Column, name: str = "document.md") -> Column:
    """module[-submodule]/version/hash-of-url/name"""
    folder = F.concat(module, F.coalesce(F.concat(F.lit("-"), F.nullif(submodule, F.lit(""))), F.lit("")))
    return F.concat_ws("/", folder, version, F.substring(F.sha2(F.encode(url, "UTF-8"), 256), 1, 16), F.lit(name))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays inside its root."""
    return path.isNotNull() & ~path.rlike(r"(^/)|(^|/)\.\.(/|$)")


def is_metadata_path(path: Column) -> Column:
    return path.rlike(r"(^|/)metadata\.json$|/metadata/[^/]*\.json$")


def relative_path(key: Column, prefixes: list[str]) -> Column:
    """A key without the first of the prefixes it begins with, else its last segment."""
    out = F.element_at(F.split(key, "/"), -1)
    for p in reversed(prefixes):
        out = F.when(key.startswith(p), F.substr(key, F.lit(len(p) + 1))).otherwise(out)
    return out


def is_http(url: Column) -> Column:
    """Whether a source address is one of the web; null and empty ones are not."""
    return F.coalesce(F.lower(url).startswith("http"), F.lit(False))


def in_preview_folder(path: Column) -> Column:
    """Whether a folder above a file is called preview, whatever the letter case."""
    folders = F.split(F.lower(path), "/")
    return F.array_contains(F.slice(folders, F.lit(1), F.greatest(F.lit(0), F.size(folders) - 1)), "preview")


def hash_in_path(path: Column) -> Column:
    """The folder of 16 hex digits in an object path, the hash of its page's address; null without one."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)([0-9a-f]{16})/[^/]+$", 1), F.lit(""))


def target_prefixes(module: Column, submodule: Column, version: Column) -> Column:
    """array(current, legacy): the prefixes objects of a target may have; one where there is no submodule."""
    sub = F.nullif(submodule, F.lit(""))
    current = F.concat(module, F.coalesce(F.concat(F.lit("-"), sub), F.lit("")), F.lit("/"), version, F.lit("/"))
    legacy = F.concat(module, F.lit("/"), sub, F.lit("/"), version, F.lit("/"))
    return F.filter(F.array(current, legacy), lambda p: p.isNotNull())


def snapshot_key(namespace: Column, kind: str, at: Column) -> Column:
    """namespace/kind_YYYY_MM_DD.zip"""
    return F.concat(namespace, F.lit(f"/{kind}_"), F.date_format(at, "yyyy_MM_dd"), F.lit(".zip"))


def namespace(model: Column, tier: Column) -> Column:
    """The folder of a model's tables: its name as a slug, and the tier."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(model), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit("-"), tier)
