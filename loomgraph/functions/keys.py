"""Keys of items, fluids, essentia and ore groups as Column expressions.

A key is ``mod:name[:meta][#digest]``, ``mod:name:*`` for any meta, or has one
of the prefixes ``fluid:``, ``essentia:``, ``ore:``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of keys that are no items, the meta that stands for
#: any, and the mod of an id without one.
NON_ITEM = ("fluid", "essentia", "ore")
WILDCARD_META = 32767
DEFAULT_MOD = "minecraft"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_item(key: Column | str) -> Column:
    return ~F.substring_index(_col(key), ":", 1).isin(*NON_ITEM)


def kind_of(key: Column | str) -> Column:
    prefix = F.substring_index(_col(key), ":", 1)
    return F.when(prefix.isin(*NON_ITEM), prefix).otherwise("item")


def mod_of(key: Column | str) -> Column:
    return F.when(is_item(key), F.substring_index(_col(key), ":", 1)).otherwise("")


def norm_key(item: Column | str, meta: Column | int | None = None, default_mod: str = DEFAULT_MOD) -> Column:
    """An id and a meta to a key: unqualified ids get a mod, meta 0 is left out,
    the wildcard meta is ``*``.  A null or blank id has no key."""
    item = F.trim(_col(item))
    full = F.when(item.contains(":"), item).otherwise(F.concat(F.lit(f"{default_mod}:"), item))
    meta = F.coalesce((F.lit(meta) if isinstance(meta, int) or meta is None else meta).try_cast("int"), F.lit(0))
    key = F.when(meta == 0, full).when(meta == WILDCARD_META, F.concat(full, F.lit(":*"))).otherwise(F.concat(full, F.lit(":"), meta.cast("string")))
    return F.when(item != "", key)


def canonical_item_key(raw: Column | str) -> Column:
    """A written id, with meta and digest or without, to a key; a meta may be
    negative."""
    raw = _col(raw)
    stem, pattern = base_key(raw), r"^(.*:.*):(-*[0-9]+)$"
    with_meta = stem.rlike(pattern)
    key = F.when(with_meta, norm_key(F.regexp_extract(stem, pattern, 1), F.regexp_extract(stem, pattern, 2))).otherwise(norm_key(stem))
    return F.when(digest_of(raw) != "", F.concat(key, F.lit("#"), digest_of(raw))).otherwise(key)


def ore_key(name: Column | str) -> Column:
    return F.concat(F.lit("ore:"), _col(name))


#: What a structure's recipes and its controller are called.
STRUCTURE_CATEGORY, STRUCTURE_CONTROLLER = "modularmachinery.recipes.%s", "modularmachinery:%s_controller"


def structure_category(registry: Column | str) -> Column:
    return F.format_string(STRUCTURE_CATEGORY, _col(registry))


def structure_controller(registry: Column | str) -> Column:
    return F.format_string(STRUCTURE_CONTROLLER, _col(registry))


def fluid_key(name: Column | str) -> Column:
    return F.concat(F.lit("fluid:"), _col(name))


def essentia_key(name: Column | str) -> Column:
    return F.concat(F.lit("essentia:"), F.lower(_col(name)))


def base_key(key: Column | str) -> Column:
    """Without the digest."""
    return F.substring_index(_col(key), "#", 1)


def digest_of(key: Column | str) -> Column:
    key = _col(key)
    return F.when(key.contains("#"), F.substring_index(key, "#", -1))


_META = r"^([^:]*:.*):(\*|[0-9]+)$"


def split_base(key: Column | str) -> Column:
    """The key without its meta; a non-item is its own base."""
    key = _col(key)
    return F.when(is_item(key) & key.rlike(_META), F.regexp_extract(key, _META, 1)).otherwise(key)


def split_meta(key: Column | str) -> Column:
    """The meta as a number, 0 if there is none; null for non-items and for ``*``."""
    key = _col(key)
    tail = F.regexp_extract(key, _META, 2)
    return F.when(~is_item(key) | (tail == "*"), F.lit(None).cast("int")).when(tail == "", 0).otherwise(tail.try_cast("int"))


def meta_is_wild(key: Column | str) -> Column:
    return is_item(key) & (F.regexp_extract(_col(key), _META, 2) == "*")


def item_stem(key: Column | str) -> Column:
    """Without digest and meta."""
    return split_base(base_key(key))


def path_of(key: Column | str) -> Column:
    """What follows the mod, without digest and meta."""
    stem = item_stem(key)
    path = F.regexp_replace(stem, "^[^:]*:?", "")
    return F.when(path == "", stem).otherwise(path)


def prettify(name: Column | str) -> Column:
    """``iron_ingot`` as ``Iron Ingot``; words with capitals stay as they are."""
    words = F.filter(F.split(F.regexp_replace(_col(name), "_", " "), "\\s+"), lambda w: w != "")
    shown = F.array_join(F.transform(words, lambda w: F.when(w.rlike("\\p{Lu}"), w).otherwise(F.initcap(w))), " ")
    return F.when(shown == "", _col(name)).otherwise(shown)


def is_unlocalized(label: Column | str) -> Column:
    """A label that is a translation key, such as ``tile.some.name``."""
    label = _col(label)
    return F.coalesce(label.endswith(".name") & ~label.contains(" ") & (F.length(label) - F.length(F.replace(label, F.lit("."), F.lit(""))) >= 2), F.lit(False))


def is_digest(suffix: Column | str) -> Column:
    return _col(suffix).rlike("^[0-9a-f]{12}$")


def variant_label(suffix: Column | str) -> Column:
    suffix = _col(suffix)
    return F.when(is_digest(suffix), F.concat(F.lit("variant "), F.substring(suffix, 1, 6))).otherwise(F.initcap(suffix))


#: Prefixes of ore groups: forms a material comes in, what is
#: found in the world, and what stores a material.
FORMS = ("nugget", "dust", "plate", "gear", "rod", "stick", "gem", "ingot", "wire", "foil", "casing", "coil", "screw", "bolt", "ring", "chunk", "crushed", "purified", "clump", "shard")
WORLD_PREFIX, STORAGE_PREFIX = "ore", "block"


def group_form(group: Column | str) -> Column:
    """The form an ore group (without ``ore:``) names, the longest prefix; null
    if it names none or no material."""
    longest = "|".join(sorted(FORMS, key=len, reverse=True))
    return F.nullif(F.lower(F.regexp_extract(_col(group), f"(?i)^({longest})(?=.)", 1)), F.lit(""))


def group_material(group: Column | str) -> Column:
    group = _col(group)
    return F.when(group_form(group).isNotNull(), F.substring(group, F.length(group_form(group)) + 1, F.length(group)))


def stored_material(group: Column | str) -> Column:
    """The material of a group of storage blocks."""
    group, n = _col(group), len(STORAGE_PREFIX)
    return F.when((F.lower(F.substring(group, 1, n)) == STORAGE_PREFIX) & (F.length(group) > n), F.substring(group, n + 1, F.length(group)))


def is_world_group(group: Column | str) -> Column:
    return _col(group).startswith(WORLD_PREFIX)


#: What blocks are called while they run.
RUNNING = ("idle", "active", "on", "off", "lit", "unlit", "powered", "unpowered", "running", "working")


def normalise_block(block: Column | str) -> Column:
    """In lower case and without any number of suffixes of a running state."""
    return F.regexp_replace(F.lower(_col(block)), f"(_({'|'.join(RUNNING)}))+$", "")


def match_forms(block: Column | str) -> Column:
    """The forms a block is matched by: itself, and for ``minecraft:mod.name``
    also ``mod:name``."""
    norm = normalise_block(block)
    path = F.when(norm.contains(":"), F.regexp_replace(norm, "^[^:]*:", "")).otherwise(norm)
    vanilla = ~norm.contains(":") | (F.substring_index(norm, ":", 1) == DEFAULT_MOD)
    pattern = r"^([^.]+)\.(.+)$"
    other = F.concat(F.regexp_extract(path, pattern, 1), F.lit(":"), F.regexp_extract(path, pattern, 2))
    return F.when(vanilla & path.rlike(pattern), F.array(norm, normalise_block(other))).otherwise(F.array(norm))


def words_of(text: Column | str) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(_col(text)), "[^a-z0-9]+"), lambda w: w != "")


def squashed(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(text), "[^A-Za-z0-9]+", ""))


def same_mod(category: Column | str, key: Column | str) -> Column:
    mod = squashed(F.substring_index(_col(key), ":", 1))
    return (mod != "") & squashed(category).contains(mod)


def id_guesses(category: Column | str) -> Column:
    """Ids of a machine that a category's name suggests: its mod, and the rest
    in snake case and in one word."""
    parts = F.filter(F.split(_col(category), "[^A-Za-z0-9]+"), lambda w: w != "")
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "_")
    snake = F.lower(F.regexp_replace(rest, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))
    mod = F.concat(F.lower(F.get(parts, F.lit(0))), F.lit(":"))
    both = F.array_distinct(F.array(F.concat(mod, snake), F.concat(mod, F.replace(snake, F.lit("_"), F.lit("")))))
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(both)


#: Categories that need no machine.
HAND_PREFIXES = ("minecraft.crafting", "crafting_shaped", "crafting_shapeless")
ALWAYS_AVAILABLE = (
    "minecraft.crafting", "minecraft.crafting.shaped", "minecraft.crafting.shapeless", "minecraft.anvil", "minecraft.brewing",
    "minecraft.fuel", "minecraft.smelting", "jei.information", "jei.description",
)
SPECIES_PATTERNS = ("jeibees.mutation", "jeibees.produce", "beetree", "chickens.laying", "chickens.henhousing", "chickens.breeding")
SPECIES_SCHEMA = 3


def is_hand_crafting(category: Column | str) -> Column:
    return F.coalesce(_col(category).rlike("^(" + "|".join(re.escape(p) for p in HAND_PREFIXES) + ")"), F.lit(False))


def needs_no_machine(category: Column | str, extra: tuple[str, ...] = (), schema: int = 0) -> Column:
    """Species are bred or grown where the dump's schema tells them apart;
    ``extra``: categories that the user has named."""
    low = F.lower(F.coalesce(_col(category), F.lit("")))
    named = low.isin(*[e.lower() for e in extra]) if extra else F.lit(False)
    return named | low.rlike("|".join(re.escape(p) for p in SPECIES_PATTERNS)) if schema >= SPECIES_SCHEMA else named


def clean_label(label: Column | str) -> Column:
    """Without format codes and space at the ends; an empty label is null."""
    return F.nullif(F.trim(F.regexp_replace(_col(label), "§.", "")), F.lit(""))


def chance(value: Column | str) -> Column:
    """A probability; what is none counts as certain."""
    value = _col(value)
    return F.when(value.between(0.0, 1.0) & ~F.isnan(value), value).otherwise(1.0)


#: The scale of costs.
FLUID_SCALE = 0.001
BASE_RAW_COST = 1.0
BUILD_FLOOR, BUILD_SCALE, BUILD_SPREAD, BUILD_KNEE = 40.0, 64.0, 70.0, 70.0 / 79.0
BLOCKED_FLOOR, BLOCKED_CEILING = 112.0, 119.0
DIMENSION_PENALTY, TOLL_PENALTY = 800.0, 5.0


def scaled_qty(qty: Column | str, p: Column | str | float = 1.0, key: Column | str | None = None) -> Column:
    """What a quantity counts for in costs: at least a thousandth."""
    p = F.lit(p) if isinstance(p, float) else _col(p)
    scale = F.lit(1.0) if key is None else F.when(kind_of(key) == "fluid", FLUID_SCALE).otherwise(1.0)
    return F.greatest(F.greatest(_col(qty), F.lit(1)) * p * scale, F.lit(0.001))


def build_entry_cost(build: Column | str) -> Column:
    s = F.log1p(_col(build) / BUILD_SCALE)
    return F.lit(BUILD_FLOOR) + BUILD_SPREAD * s / (s + BUILD_KNEE)


def blocked_entry_cost(fraction: Column | str) -> Column:
    f = F.least(F.greatest(_col(fraction), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.lit(BLOCKED_FLOOR) + (BLOCKED_CEILING - BLOCKED_FLOOR) * f, F.lit(BLOCKED_CEILING))


def raw_floor(gated: Column, tolled: Column) -> Column:
    return F.lit(BASE_RAW_COST) + DIMENSION_PENALTY * gated.cast("double") + TOLL_PENALTY * tolled.cast("double")


#: What the entry price of a machine nobody can price is.
UNPRICED_MACHINE = BUILD_FLOOR + BUILD_SPREAD + 1.0


def entry_region(price: Column | str) -> Column:
    """Which band of entry prices a price is in."""
    price, near = _col(price), 1e-9
    inside = lambda low, high: price.between(low - near, high + near)
    return (
        F.when(inside(BUILD_FLOOR, BUILD_FLOOR + BUILD_SPREAD), "priced").when(inside(UNPRICED_MACHINE, UNPRICED_MACHINE), "unpriced item")
        .when(inside(BLOCKED_FLOOR, BLOCKED_CEILING), "blocked structure").otherwise("outside")
    )


def damage_base(key: Column | str, max_damage: Column | str) -> Column:
    """A worn item's key without its wear, by the stem's ``max_damage`` (null:
    the item does not wear); the digest stays."""
    key, meta = _col(key), split_meta(base_key(key))
    plain = F.when(digest_of(key).isNull(), item_stem(key)).otherwise(F.concat(item_stem(key), F.lit("#"), digest_of(key)))
    return F.when(_col(max_damage).isNotNull() & (meta > 0), plain).otherwise(key)


def damage_of(key: Column | str, max_damage: Column | str) -> Column:
    """A worn item's wear, or null."""
    meta = split_meta(base_key(key))
    return F.when(_col(max_damage).isNotNull() & (meta > 0), meta)


def bucket(ts: Column | str, size: int) -> Column:
    ts = _col(ts)
    return ts - F.pmod(ts, F.lit(size))


def duration_seconds(text: str) -> int:
    """``90s``, ``30m``, ``2h``, ``7d``."""
    units = {"s": 1, "m": 60, "h": 3600, "d": 86400}
    if len(text) < 2 or text[-1] not in units or not text[:-1].isdigit():
        raise ValueError(f"not a duration: {text!r}")
    return int(text[:-1]) * units[text[-1]]
