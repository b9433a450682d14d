"""Column functions over item names, catalog variants, versions and model records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Oldest supported version, required release assets, languages in order of preference.
OLDEST_VERSION = (0, 26, 1)
REQUIRED_ASSETS = ("model.json", "model.onnx", "attribute_directions.json")
LANGUAGES = ("en-US", "en", "1033")

#: The attributes that a model's directions have.
ATTRIBUTES = (
    "angular", "artistic", "attention-grabbing", "attractive", "bad", "boring", "calm", "capitals", "charming", "clumsy", "complex", "cursive", "delicate",
    "disorderly", "display", "dramatic", "formal", "fresh", "friendly", "gentle", "graceful", "happy", "italic", "legible", "modern", "monospace", "playful",
    "pretentious", "serif", "sharp", "sloppy", "soft", "strong", "technical", "thin", "warm", "wide",
)
#: The levels of the default emphasis; all other attributes have level 0.
DEFAULT_EMPHASIS = {
    "serif": 3, "cursive": 2, "italic": -2, "formal": 2, "playful": 2, "thin": -2, "angular": 2, "artistic": 2, "attention-grabbing": 2, "attractive": 2,
    "bad": 1, "boring": -1, "capitals": -2, "charming": 2, "clumsy": 1, "complex": 1, "disorderly": 2, "display": -2, "dramatic": 1, "gentle": 2, "graceful": 2,
    "happy": 1, "modern": 2, "monospace": -2, "pretentious": 2, "sharp": 1, "sloppy": 1, "strong": 1, "warm": 1, "wide": 2,
}
#: How many families a set of the catalog has, most popular first; 0 for all.
POPULAR = (100, 200, 300, 500, 1000, 1500, 0)


def safe_name(family: Column, weight: Column) -> Column:
    """``weight_family`` with blanks and slashes as underscores (F1; different families can collide)."""
    return F.concat(weight.cast("string"), F.lit("_"), F.translate(family, " /\\", "___"))


def family_of_stem(stem: Column) -> Column:
    """The family before the first ``_Weight`` of a file stem, underscores as blanks; null without a marker (F2)."""
    at = F.instr(stem, "_Weight")
    return F.when(at > 0, F.translate(F.substring(stem, F.lit(1), at - 1), "_", " "))


def preferred(names: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The value of the first language that there is, else of the smallest key."""
    first = F.element_at(F.array_sort(F.map_keys(names)), 1)
    return F.when(F.size(names) > 0, F.coalesce(*(names[x] for x in languages), names[first]))


def localized(names: Column) -> Column:
    """``en-US``, ``en``, any; an empty choice is null."""
    return F.nullif(preferred(names, LANGUAGES[:2]), F.lit(""))


def localized_map(entries: Column) -> Column:
    """Map of (language, value) entries: empty values dropped, a missing language is ``und``, the last duplicate wins."""
    good = F.transform(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(F.coalesce(e["language"], F.lit("und")).alias("language"), e["value"].alias("value")))
    keys = F.array_distinct(F.transform(good, lambda e: e["language"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(good, lambda e: e["language"] == k), -1)["value"]))


def family_key(typographic: Column, family: Column, display: Column) -> Column:
    """F6."""
    return F.coalesce(preferred(typographic), preferred(family), display)


def style_key(typographic: Column, style: Column) -> Column:
    """F7."""
    return F.coalesce(preferred(typographic), preferred(style), F.lit("Regular"))


def display_name(full: Column, compatible: Column, family: Column, postscript: Column) -> Column:
    """F8."""
    return F.coalesce(full, compatible, family, postscript)


def subset_requirements(text: Column, subsets_of: Column) -> Column:
    """For each character of a text the subsets that hold it (F9): blanks, control characters and unknown ones ask for
    nothing, and the subset ``menu`` never counts. ``subsets_of``: map from character to subsets."""
    chars = F.filter(F.split(text, ""), lambda c: (c != "") & ~c.rlike(r"^[\s\p{Cc}]$"))
    each = F.transform(chars, lambda c: F.filter(F.coalesce(subsets_of[c], F.array().cast("array<string>")), lambda s: s != "menu"))
    return F.filter(each, lambda r: F.size(r) > 0)


def covers(requirements: Column, subsets: Column) -> Column:
    """Every requirement shares a subset with those offered; none asks for nothing (P5)."""
    return F.exists(F.array(subsets), lambda offered: F.forall(requirements, lambda r: F.arrays_overlap(r, offered)))  # what is offered is computed once


def api_weight(weight: Column, variants: Column) -> Column:
    """The catalog's name of a weight, null if it is not offered (F10): 400 is also ``regular``, 700 ``bold``; else the exact name."""
    has = lambda v: F.array_contains(variants, v)
    plain = weight.cast("string")
    return (
        F.when((weight == 400) & (has(F.lit("regular")) | has(F.lit("400"))), F.lit("400"))
        .when((weight == 700) & (has(F.lit("bold")) | has(F.lit("700"))), F.lit("700"))
        .when(~weight.isin(400, 700) & has(plain), plain)
    )


def offers_any(weights: Column, variants: Column) -> Column:
    """P6."""
    return F.exists(weights, lambda w: api_weight(w, variants).isNotNull())


def in_weight_window(target: Column, actual: Column) -> Column:
    """Within 50 of the target; the bound on the side of 400 counts, the other one does not."""
    d = actual - target
    return F.when(target < 400, (d > -50) & (d <= 50)).when(target > 400, (d >= -50) & (d < 50)).otherwise((d > -50) & (d < 50))


def glyphs_cover(text: Column, covered: Column) -> Column:
    """Every character but NUL and U+FFFD is covered."""
    return F.forall(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.isin("\0", "�") | F.array_contains(covered, c))


def internal_name(names: Column) -> Column:
    """Any name that holds ``LastResort`` or starts with a dot."""
    return F.exists(names, lambda v: v.contains("LastResort") | v.startswith("."))


def active_emphasis(levels: Column) -> Column:
    """Non-zero levels clamped to -4..4, as entries sorted by name."""
    clamped = F.transform_values(F.map_filter(levels, lambda k, v: v != 0), lambda k, v: F.greatest(F.lit(-4), F.least(F.lit(4), v.cast("int"))))
    return F.array_sort(F.map_entries(clamped))


def version_key(version: Column) -> Column:
    """A struct that orders semantic versions (a leading ``v`` is allowed): release numbers, then a pre-release before its release; null if unreadable."""
    bare = F.regexp_replace(version, "^v", "")
    shape = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    part = lambda i: F.regexp_extract(bare, shape, i)
    pre = F.transform(
        F.split(part(4), r"\."),
        lambda p: F.struct(F.when(p.rlike(r"^\d+$"), 0).otherwise(1).alias("kind"), F.when(p.rlike(r"^\d+$"), p.cast("long")).otherwise(F.lit(0)).alias("n"), p.alias("s")),
    )
    return F.when(bare.rlike(shape), F.struct(part(1).cast("long"), part(2).cast("long"), part(3).cast("long"), (part(4) == "").cast("int"), pre))


def supported_version(modified: Column, created: Column, oldest: tuple[int, int, int] = OLDEST_VERSION) -> Column:
    """The version that last wrote a session (else the one that made it) is readable and not too old."""
    key = version_key(F.coalesce(modified, created))
    least = version_key(F.lit(".".join(map(str, oldest))))
    return F.coalesce(key >= least, F.lit(False))


def valid_model_id(model: Column) -> Column:
    """P10."""
    return model.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$")


def valid_digest(digest: Column) -> Column:
    return digest.rlike("^[0-9A-Fa-f]{64}$")


def valid_manifest(m: Column, expected: Column) -> Column:
    """M has api_version, id, name, parameter_count (null allowed) and digests (array)."""
    return F.coalesce(
        (m["api_version"] == 1) & (m["id"] == expected) & (F.trim(m["name"]) != "") & (F.coalesce(m["parameter_count"], F.lit(1)) != 0) & F.forall(m["digests"], valid_digest),
        F.lit(False),
    )


def valid_release(r: Column, required: tuple[str, ...] = REQUIRED_ASSETS) -> Column:
    """Neither draft nor pre-release, exactly the required assets, each with a size and a digest."""
    names = F.array_sort(F.transform(r["assets"], lambda a: a["name"]))
    each = F.forall(r["assets"], lambda a: (a["size"] > 0) & valid_digest(F.regexp_replace(a["digest"], "^sha256:", "")))
    return F.coalesce(~r["draft"] & ~r["prerelease"] & (names == F.array(*map(F.lit, sorted(required)))) & each, F.lit(False))


def valid_directions(directions: Column, names: tuple[str, ...] = ATTRIBUTES, dim: int = 512) -> Column:
    """Exactly these names, each a finite vector of this length and of unit norm within a hundredth (of the square)."""
    unit = lambda v: F.abs(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) - 1) <= 0.01
    finite = lambda v: F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    same = F.array_sort(F.map_keys(directions)) == F.array(*map(F.lit, sorted(names)))
    return F.coalesce(same & F.forall(F.map_values(directions), lambda v: (F.size(v) == dim) & finite(v) & unit(v)), F.lit(False))


def digest_matches(content: Column, expected: Column) -> Column:
    """P13."""
    return F.sha2(content, 256) == F.lower(expected)


def weight_label(weight: Column) -> Column:
    """the weight rounded to hundreds as Th, El, L, R, M, S, B, Eb or Bl."""
    labels = F.array(*map(F.lit, ("Th", "El", "L", "R", "M", "S", "B", "Eb", "Bl")))
    return F.get(labels, (F.floor(weight / 100 + 0.5) - 1).cast("int"))


def css_query(family: Column, weight: Column, text: Column) -> Column:
    """family with ``+`` for blanks, weight and percent-encoded text of a stylesheet address."""
    quoted = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit("family="), F.translate(family, " ", "+"), F.lit(":wght@"), weight, F.lit("&text="), quoted)


def css_source(css: Column) -> Column:
    """the first ``src: url(...)``."""
    return F.nullif(F.regexp_extract(css, r"src:\s*url\(([^)]+)\)", 1), F.lit(""))


def font_container(content: Column) -> Column:
    """S10's sniffing by magic number: woff2, ttf, otf or null."""
    head = F.substring(content, 1, 4)
    return F.when(head == F.lit(b"wOF2"), "woff2").when(head == F.lit(b"\0\1\0\0"), "ttf").when(head == F.lit(b"OTTO"), "otf")


def title_of(title: Column, sample: Column) -> Column:
    """F21."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(sample, F.lit("")), F.lit("A"))


def coerced(value: Column, kind: str, default) -> Column:
    """blank, unreadable, zero and NaN give the default."""
    number = value.try_cast(kind)
    return F.coalesce(F.when((number != 0) & ~F.isnan(number.cast("double")), number), F.lit(default).cast(kind))


def preview_key(*inputs: Column) -> Column:
    """one hash of everything that shows in a preview."""
    return F.xxhash64(*(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(" ")) for c in inputs))


def emphasis_preset(levels: Column, default: Column | None = None) -> Column:
    """``none`` if every level is zero, ``default`` if they equal the preset, else ``custom``."""
    default = F.create_map(*(F.lit(x) for kv in DEFAULT_EMPHASIS.items() for x in kv)) if default is None else default
    entries = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: v != 0)))
    return F.when(F.size(entries(levels)) == 0, "none").when(entries(levels) == entries(default), "default").otherwise("custom")
