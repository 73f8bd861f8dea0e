"""Column functions of keys, paths, status words, grades, JSON fragments and log text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")
#: Words of each status.
STATUS_WORDS = {"pass": ("pass", "success", "clean"), "review": ("review", "warning", "degraded"), "fail": ("fail", "failed", "contaminated", "invalid")}
GRADE_NUMBERS = {"A": 4, "B": 3, "C": 2, "F": 0}


def normalize_status(status: Column) -> Column:
    """pass, review or fail; whatever is not known is fail."""
    word = F.lower(F.trim(status))
    return F.when(word.isin(*STATUS_WORDS["pass"]), "pass").when(word.isin(*STATUS_WORDS["review"]), "review").otherwise("fail")


def failure_classify(message: Column, variant: str = "ladder") -> Column:
    """Class of an error text. `ladder` looks for crashes first, `runner` for missing files."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = low.contains  # the words below are fixed values
    if variant == "ladder":
        crash = has("3221226505") | has("native crash") | (has("texturemesh") & has("exit"))
        return (
            F.when(low == "", "unknown").when(crash, "native_crash").when(has("out of memory") | has("oom"), "oom")
            .when(has("no such file") | has("file not found"), "missing_file").when(has("runtimeerror") | has("runtime error"), "runtime").otherwise("unknown")
        )
    crash = has("3221226505") | has("0xc0000005") | has("texturemesh_native_crash") | has("native crash")
    return (
        F.when(has("no such file") | has("file not found") | has("missing artifact"), "missing_file").when(crash, "native_crash")
        .when(has("out of memory") | has("memory allocation") | has("oom"), "oom").when(has("timeout") | has("timed out"), "timeout").otherwise("unknown")
    )


def cache_key(width: Column, height: Column, device: Column, focal_mm: Column, camera: Column) -> Column:
    """device|WxH|focal|camera; focal lengths fall into bins of 0.5 mm, halves to even; blanks are any."""
    def name(c: Column) -> Column:
        word = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
        return F.when(F.coalesce(word, F.lit("")) == "", "any").otherwise(word)

    focal = F.when(focal_mm > 0, F.concat(F.lit("f"), F.format_string("%.1f", F.bround(focal_mm * 2) / 2))).otherwise("fany")
    size = F.concat(width.cast("int").cast("string"), F.lit("x"), height.cast("int").cast("string"))
    return F.concat_ws("|", name(device), size, focal, name(camera))


def config_hash(parameters: dict[str, Column]) -> Column:
    """md5 of the parameters as JSON with sorted keys."""
    return F.md5(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(parameters.items())))))


def product_id(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


def path_parts(path: Column, root: str) -> Column:
    """Name, stem, suffix, path relative to root (unchanged where it is not below it), and input mode."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    base = root.rstrip("/") + "/"
    return F.struct(
        name.alias("name"), F.substring(name, F.lit(1), F.length(name) - F.length(suffix)).alias("stem"), suffix.alias("suffix"),
        F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path).alias("relative"),
        F.when(F.lower(suffix).isin(*VIDEO_SUFFIXES), "video").otherwise("single_image").alias("mode"),
    )


#: What stands before a secret, and the secret.
SECRETS = (r"(?i)(Authorization:\s*Bearer\s+)[^\s]+", r"(?i)(Bearer\s+)[^\s]+", r"(?i)(api_key\s*[=:]\s*)[^\s&,}\]]+", r"(?i)(token\s*[=:]\s*)[^\s&,}\]]+")


def redact_secrets(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Known secrets first, then bearer, api_key and token values, in that order."""
    for s in secrets:
        if s:
            text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "$1[REDACTED]")
    return text


def redact_nested(col: Column, dtype: T.DataType, secrets: tuple[str, ...] = ()) -> Column:
    """Every string inside a struct, array or map value, redacted."""
    if isinstance(dtype, T.StringType):
        return redact_secrets(col, secrets)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: redact_nested(x, dtype.elementType, secrets))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: redact_nested(v, dtype.valueType, secrets))
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(redact_nested(col[f.name], f.dataType, secrets).alias(f.name) for f in dtype.fields)))
    return col


def coerce_bbox(json: Column) -> Column:
    """array<double> of three from [x,y,z], {x,y,z}, {width,height,depth} or {size:[...]}; null otherwise."""
    v = F.try_parse_json(json)

    def listed(path: str) -> Column:
        values = F.try_variant_get(v, path, "array<double>")
        return F.when(F.size(values) == 3, values)

    def named(*keys: str) -> Column:
        values = F.array(*(F.try_variant_get(v, f"$.{k}", "double") for k in keys))
        return F.when(~F.exists(values, lambda x: x.isNull()), values)

    return F.coalesce(listed("$"), named("x", "y", "z"), named("width", "height", "depth"), listed("$.size"))


def strip_unknown_fields(json: Column, schema: T.StructType) -> Column:
    """Declared fields only, as a struct."""
    return F.from_json(json, schema)


def merge_precedence(*layers: dict[str, Column]) -> dict[str, Column]:
    """Columns of layers merged by name: a later layer wins where it is not null."""
    names = dict.fromkeys(n for layer in layers for n in layer)
    return {n: F.coalesce(*(layer[n] for layer in reversed(layers) if n in layer)) for n in names}


def delivered_texture(texture_count: Column, material_count: Column, has_uv_accessor: Column) -> Column:
    """Whether an export holds textured geometry: a missing material count is 1 where textures exist."""
    count = F.coalesce(texture_count, F.lit(0))
    materials = F.coalesce(material_count, F.when(count > 0, 1).otherwise(0))
    return (count > 0) & (materials > 0) & F.coalesce(has_uv_accessor, F.lit(False))


def provenance_steps(manifest: dict[str, Column]) -> Column:
    """Ordered steps of a manifest (mesh_path, texture_path, engine and statuses of optional blocks); absent blocks are left out."""
    def step(name: str, status: Column, tool: Column) -> Column:
        return F.struct(F.lit(name).alias("step"), status.alias("status"), tool.alias("tool"))

    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    steps = [step("reconstruction", F.when(filled(manifest["mesh_path"]), "ok").otherwise("failed"), F.coalesce(manifest["engine"], F.lit("unknown")))]
    steps.append(F.when(filled(manifest["texture_path"]), step("texturing", F.lit("ok"), F.coalesce(manifest["texturing_engine"], F.lit("openmvs_texturemesh")))))
    for name, tool in (("blender_cleanup", "blender"), ("gltf_optimization", "gltf-transform"), ("gltf_validation", "gltf_validator")):
        steps.append(F.when(manifest[name].isNotNull(), step(name, manifest[name], F.lit(tool))))
    return F.array_compact(F.array(*steps))


def grade_rank(grade: Column) -> Column:
    """A 4, B 3, C 2, all else 0."""
    word = F.upper(F.coalesce(grade, F.lit("F")))
    out = F.lit(0)
    for letter, n in GRADE_NUMBERS.items():
        out = F.when(word == letter, n).otherwise(out)
    return out.cast("long")


def grade_letter(rank: Column) -> Column:
    return F.when(rank == 4, "A").when(rank == 3, "B").when(rank == 2, "C").otherwise("F")


def worst_of(*verdicts: Column, order: tuple[str, ...] = ("pass", "review", "reshoot")) -> Column:
    """The worst of verdicts in `order`; unknown or null counts as the best."""
    def rank(c: Column) -> Column:
        out = F.lit(0)
        for i, v in enumerate(order):
            out = F.when(c == v, i).otherwise(out)
        return out

    top = F.greatest(*map(rank, verdicts), F.lit(0))
    return F.element_at(F.array(*map(F.lit, order)), top + 1)


def ordered_distinct(codes: Column) -> Column:
    """Codes without repeats, first occurrences kept in order."""
    return F.array_distinct(codes)


def like_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))
