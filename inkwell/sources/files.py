"""Files of a wiki tree as DataFrames.

The built-in readers hide names that begin with an underscore or a dot, which
are valid link targets, so a tree is listed by the driver (paths and sizes) and
read by the executors where content is wanted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text

SCHEMA = "path string, length long, content binary"
#: Bytes of files that a worker holds at once.
FRAME_BYTES = 16 << 20


def list_tree(spark: SparkSession, root: str | Path) -> DataFrame:
    """path (below root, with slashes), length, content of every file, dotfiles and underscored folders too.

    The root must be on a file system that driver and executors all see, as a
    mounted share is; the built-in readers would reach further but hide names.
    """
    root = Path(root)
    rows = []
    for folder, _, names in os.walk(root):
        for name in names:
            p = Path(folder, name)
            if p.is_file():
                rows.append((p.relative_to(root).as_posix(), p.stat().st_size, str(p)))
    files = spark.createDataFrame(rows, "path string, length long, place string")

    def load(batches):
        for pdf in batches:
            # By bytes, so that no frame holds many files' contents at once; a larger file is a frame of its own.
            for _, some in pdf.groupby((pdf["length"].cumsum() // FRAME_BYTES).to_numpy()):
                content = [Path(p).read_bytes() if os.access(p, os.R_OK) else None for p in some["place"]]
                yield some[["path", "length"]].assign(content=content)

    return files.repartition(max(1, min(64, len(rows) // 64))).mapInPandas(load, SCHEMA)


def lint_text(content: Column) -> Column:
    """Text of a file; what cannot be decoded is empty."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise("")


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _name(path: Column) -> Column:
    return F.element_at(_parts(path), -1)


def _folders_ok(path: Column) -> Column:
    return ~F.arrays_overlap(F.slice(_parts(path), F.lit(1), F.size(_parts(path)) - 1), F.array(*[F.lit(d) for d in fixed.EXCLUDED_DIRS]))


def content_pages(files: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """path, family, expected_type, slug, text of content pages as the health report sees them."""
    families = families or fixed.PAGE_FAMILIES
    kinds = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    path, family = F.col("path"), F.get(_parts(F.col("path")), F.lit(0))
    name = F.lower(_name(path))
    keep = (F.size(_parts(path)) > 1) & family.isin(*families) & name.endswith(".md") & ~name.isin(*fixed.EXCLUDED_NAMES) & _folders_ok(path)
    keep &= ~F.upper(_name(path)).startswith("INDEX") & (name != "log.md")
    return files.where(keep).select("path", family.alias("family"), kinds[family].alias("expected_type"), text.path_stem(path).alias("slug"), lint_text(F.col("content")).alias("text"))


def search_pages(files: DataFrame, families: Iterable[str] | None = None) -> DataFrame:
    """path, family, slug, text of pages as the search sees them: names are case-sensitive."""
    path, family = F.col("path"), F.get(_parts(F.col("path")), F.lit(0))
    name = _name(path)
    keep = (F.size(_parts(path)) > 1) & family.isin(*(families or fixed.PAGE_FAMILIES)) & name.endswith(".md") & ~name.isin(*fixed.SEARCH_EXCLUDED_NAMES) & _folders_ok(path)
    keep &= ~name.startswith("INDEX") & ~name.startswith("LOG")
    slug = F.regexp_replace(F.array_join(F.slice(_parts(path), F.lit(2), F.size(_parts(path))), "/"), r"\.md$", "")
    return files.where(keep).select("path", family.alias("family"), slug.alias("slug"), F.decode("content", "UTF-8").alias("text"))


def index_documents(files: DataFrame, index: dict | None = None) -> DataFrame:
    """path, text of the top-level index documents."""
    index = index or fixed.INDEX
    path = F.col("path")
    keep = (F.size(_parts(path)) == 1) & F.lower(path).endswith(".md") & ((path == index["root"]) | path.startswith(index["shard_prefix"]))
    return files.where(keep).select("path", lint_text(F.col("content")).alias("text"))


def inbox(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").startswith("raw/inbox/") & ~_name(F.col("path")).startswith(".")).select("path")


def log_entries(log: DataFrame) -> DataFrame:
    """log(text) -> line_no, entry: lines that begin an entry, without their marks."""
    lines = log.select(F.posexplode(text.split_lines(F.col("text"))).alias("i", "line"))
    return lines.where(F.col("line").startswith("## [")).select((F.col("i") + 1).alias("line_no"), text.strip(F.col("line").substr(F.lit(4), F.length("line"))).alias("entry"))


def last_log_entry(log: DataFrame) -> DataFrame:
    return log_entries(log).agg(F.max_by("entry", "line_no").alias("last_log_entry"))


class ConfigError(ValueError):
    """A configuration that is there but not usable."""


def load_config(path: str | Path | None) -> dict:
    """Defaults with a file's sections laid over them; families replace, other sections merge; unknown keys are ignored."""
    out = {
        "page_families": dict(fixed.PAGE_FAMILIES), "caps": dict(fixed.CAPS), "index": dict(fixed.INDEX),
        "staleness_days": dict(fixed.STALENESS_DAYS), "scale_thresholds": dict(fixed.SCALE_THRESHOLDS), "privacy": {"staging_dir": fixed.STAGING_DIR},
    }
    if path is None or not Path(path).is_file():
        return out
    try:
        said = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"unreadable configuration: {e}") from e
    if not isinstance(said, dict):
        raise ConfigError("the configuration is no object")
    for section, known in out.items():
        new = said.get(section)
        if new is None:
            continue
        if not isinstance(new, dict):
            raise ConfigError(f"{section} is no object")
        if section == "page_families":
            if not new or not all(isinstance(k, str) and k and isinstance(v, str) and v for k, v in new.items()):
                raise ConfigError("page_families needs names")
            out[section] = dict(new)
            continue
        for key, default in known.items():
            if key not in new:
                continue
            value = new[key]
            if isinstance(default, int) and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
                raise ConfigError(f"{section}.{key} is no count")
            if isinstance(default, str) and (not isinstance(value, str) or not value):
                raise ConfigError(f"{section}.{key} is no name")
            known[key] = value
    if out["caps"]["soft_lines"] > out["caps"]["hard_lines"]:
        raise ConfigError("the soft cap is above the hard cap")
    return out


def configured_allowlist(config: Path) -> Path | None:
    """Where a configuration has its allowlist, from its own folder; none if it is unreadable or names none."""
    try:
        said = json.loads(config.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    section = said.get("privacy") if isinstance(said, dict) else None
    name = section.get("allowlist") if isinstance(section, dict) else None
    return config.parent / name if isinstance(name, str) and name else None


def configured_families(config: str | Path | None) -> dict[str, str]:
    """Page families as the search and the scaffolder take them: the defaults where the configuration has none or is unreadable."""
    try:
        said = json.loads(Path(config).read_text(encoding="utf-8")) if config else {}
    except (OSError, ValueError):
        said = {}
    families = said.get("page_families") if isinstance(said, dict) else None
    return dict(families) if isinstance(families, dict) and families else dict(fixed.PAGE_FAMILIES)


def ledger_settings(path: str | Path | None, start: str | Path) -> dict:
    """taxonomy and destinations of a ledger: a named configuration must be readable, one found on the way up need not be."""
    out = {"taxonomy": fixed.TAXONOMY_VERSION, "destinations": []}
    place = path or find_config([start, Path.cwd()], fixed.CONFIG_NAME)
    if place is None:
        return out
    try:
        said = json.loads(Path(place).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        if path:
            raise ConfigError("the configuration is not readable") from e
        return out
    section = lambda x, name: x[name] if isinstance(x, dict) and isinstance(x.get(name), dict) else {}
    version = section(said, "privacy").get("taxonomy_version")
    if isinstance(version, str):
        out["taxonomy"] = version
    out["destinations"] = sorted(section(section(said, "share"), "destinations"))
    return out


class AllowlistError(ValueError):
    """An allowlist that is there but malformed."""


def load_allowlist(spark: SparkSession, path: str | Path | None) -> DataFrame | None:
    """entries(path, sha256, reason_codes, approved_by, date), validated; none if there is no file."""
    if path is None or not Path(path).is_file():
        return None
    try:
        said = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise AllowlistError("the allowlist is not readable JSON") from e
    entries = said.get("entries") if isinstance(said, dict) else None
    if not isinstance(said, dict) or said.get("schema_version") != 1 or isinstance(said.get("schema_version"), bool) or not isinstance(entries, list):
        raise AllowlistError("the allowlist needs schema_version 1 and entries")
    rows = []
    for n, e in enumerate(entries):
        words = isinstance(e, dict) and all(isinstance(e.get(k), str) and e.get(k).strip() for k in ("path", "sha256", "approved_by", "date"))
        codes = e.get("reason_codes") if isinstance(e, dict) else None
        hex_ = words and len(e["sha256"]) == 64 and set(e["sha256"]) <= set("0123456789abcdef")
        if not (words and hex_ and isinstance(codes, list) and codes and all(isinstance(c, str) and c for c in codes)):
            raise AllowlistError(f"entry {n} is malformed")
        rows.append((e["path"], e["sha256"], codes, e["approved_by"], e["date"]))
    return spark.createDataFrame(rows, "path string, sha256 string, reason_codes array<string>, approved_by string, date string")


def find_config(start: Iterable[str | Path], name: str) -> Path | None:
    """The first such file when walking up from each start, in order."""
    for s in start:
        at = Path(s).resolve()
        for folder in (at, *at.parents):
            if (folder / name).is_file():
                return folder / name
    return None
