"""JSON held in text: find it, check it, parse it."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.arrays import let
from pairloom.functions.text import SPACES

FENCE = "```[a-z]*[" + SPACES + "]*|[" + SPACES + "]*```"
BLANKS = " \t\n\r"  # what may stand around a JSON value
ESCAPED = "[\"\\\\\\x00-\\x1f\\x{fffd}]"
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def strict_variant(text: Column) -> Column:
    """``[value, check]`` as a variant, to be used with :func:`is_strict`.

    Spark's JSON functions read the first value and ignore what follows it. Inside an array
    that ends with a number derived from the text, anything after the first value moves or
    hides that number. ``text`` is used several times here: bind a costly one by ``let``, since a filter that is pushed down
    puts its expression in place of the column. Where an object repeats a key the last one counts, which needs the session
    setting ``REPEATED_KEYS``.
    """
    session = SparkSession.getActiveSession()
    if session is None or session.conf.get(REPEATED_KEYS, "false").lower() != "true":
        raise ValueError(f"set {REPEATED_KEYS} to true: the last of repeated keys counts")
    value = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]")))
    return F.when(~_cut_off(text), value)


def _cut_off(text: Column) -> Column:
    """An object whose end is missing: never JSON, and found without the parser's costly exception.

    Only the first and the last character are looked at; where one is blank, the parser decides.
    """
    ended = F.lit(False)
    for last in "}" + BLANKS:
        ended = ended | F.endswith(text, F.lit(last))
    return F.startswith(text, F.lit("{")) & ~ended


def is_strict(variant: Column, text: Column) -> Column:
    return F.coalesce(F.try_variant_get(variant, "$[1]", "bigint") == F.xxhash64(text), F.lit(False))


def is_json(text: Column) -> Column:
    """True where the whole text is one JSON value."""
    return let(text, lambda x: is_strict(strict_variant(x), x))


def opens_object(text: Column) -> Column:
    """Of a text that is one JSON value: whether that value is an object."""
    return F.startswith(text, F.lit("{")) | F.startswith(F.ltrim(text, F.lit(BLANKS)), F.lit("{"))


def quoted(text: Column) -> Column:
    """The text as a JSON string; NULL stays NULL. A text without a character to escape (or one that is not UTF-8) needs no JSON writer."""
    plain = ~F.rlike(text, F.lit(ESCAPED))
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).when(text.isNotNull(), F.btrim(F.to_json(F.array(text)), F.lit("[]")))


def strip_fences(text: Column) -> Column:
    """Remove code fences with any lower-case tag."""
    return F.regexp_replace(text, FENCE, "")


def outer_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL where there is no such span."""
    return F.nullif(F.regexp_extract(text, r"\{[\s\S]*\}", 0), F.lit(""))


def balanced_object(text: Column) -> Column:
    """First span whose braces balance, braces inside strings counted too; NULL where there is none.

    Braces and the texts between them are read from the right: a ``{`` is matched where closing braces are still
    open, and the leftmost matched one begins the span. Read from there, the span ends where the depth is 0 again.
    """
    parts = F.regexp_extract_all(text, F.lit("[{}]|[^{}]+"), F.lit(0))
    opens, closes = (lambda x: x == "{"), (lambda x: x == "}")

    def leftward(s, x):
        matched = opens(x) & (s["open"] > 0)
        at = s["at"] - F.length(x)
        open_ = F.when(closes(x), s["open"] + 1).when(matched, s["open"] - 1).otherwise(s["open"])
        return F.struct(at.alias("at"), open_.alias("open"), F.when(matched, at).otherwise(s["start"]).alias("start"))

    def span(found):
        def rightward(s, x):
            inside = (s["at"] >= found["start"]) & (s["end"] < 0)
            depth = s["depth"] + F.when(~inside, 0).when(opens(x), 1).when(closes(x), -1).otherwise(0)
            at = s["at"] + F.length(x)
            return F.struct(at.alias("at"), depth.alias("depth"), F.when(inside & closes(x) & (depth == 0), at).otherwise(s["end"]).alias("end"))

        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("end"))
        end = F.aggregate(found["parts"], begin, rightward)["end"]
        return F.when(found["start"] >= 0, F.substring(text, found["start"] + 1, end - found["start"]))

    def start(pieces):
        begin = F.struct(F.length(text).alias("at"), F.lit(0).alias("open"), F.lit(-1).alias("start"))
        first = F.aggregate(F.reverse(pieces), begin, leftward)["start"]
        return F.struct(pieces.alias("parts"), first.alias("start"))

    return let(let(parts, start), span)


def if_json(text: Column, otherwise: Column | None = None) -> Column:
    """The text where it parses; computed once however costly it is."""
    return let(text, lambda x: F.when(is_json(x), x) if otherwise is None else F.when(is_json(x), x).otherwise(otherwise))


def repair_object(text: Column) -> Column:
    """The text if it parses, else the first of two brace repairs that parses, else NULL."""

    def repaired(x):
        once = F.replace(x, F.lit(",{"), F.lit(","))
        twice = let(once, lambda y: F.regexp_replace(y, r"\}[" + SPACES + r"]*\{", ","))
        return F.when(is_json(x), x).otherwise(if_json(once, if_json(twice)))

    return let(text, repaired)


def recover_object(text: Column) -> Column:
    """Outer object as it stands, else after removing fences, else NULL."""
    return if_json(outer_object(text), if_json(outer_object(strip_fences(text))))


def has_keys(names: Column, keys: list[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in sorted(keys)])
    return F.coalesce(F.sort_array(names) == wanted, F.lit(False))


def object_keys(variant: Column, path: str = "$[0]") -> Column:
    """Distinct keys of the object at ``path`` of :func:`strict_variant`; NULL for anything else."""
    return F.map_keys(F.try_variant_get(variant, path, "map<string,variant>"))


def object_has_keys(variant: Column, keys: list[str]) -> Column:
    """True where the value in :func:`strict_variant` is an object with exactly these keys."""
    return has_keys(object_keys(variant), keys)


def strict_object_has_keys(variant: Column, text: Column, keys: list[str]) -> Column:
    """:func:`keys_are` for a text whose :func:`strict_variant` is at hand; the names are read from the text, for a map of all members copies them."""
    return F.coalesce(is_strict(variant, text) & has_keys(F.array_distinct(F.json_object_keys(text)), keys), F.lit(False))


def keys_are(text: Column, keys: list[str]) -> Column:
    """True where any text is an object with exactly these keys."""
    return let(text, lambda x: let(strict_variant(x), lambda v: is_strict(v, x) & object_has_keys(v, keys)))


def items_have_keys(variant: Column, name: str, keys: list[str]) -> Column:
    """True where member ``name`` of the value in :func:`strict_variant` is an array of objects with exactly these keys."""
    items = F.try_variant_get(variant, "$[0]." + name, "array<map<string,variant>>")
    return F.coalesce(F.forall(items, lambda item: has_keys(F.map_keys(item), keys)), F.lit(False))


def _string_member(variant: Column, name: str) -> Column:
    """String member of the value in :func:`strict_variant`; NULL for other types."""
    return string_of(member(variant, name))


def member(variant: Column, name: str) -> Column:
    """A member of the value in :func:`strict_variant`, as a variant; NULL where it is absent."""
    return F.try_variant_get(variant, "$[0]." + name, "variant")


def string_of(variant: Column) -> Column:
    """The text of a variant that is a JSON string; NULL for other types."""
    return F.when(F.schema_of_variant(variant) == "STRING", F.try_variant_get(variant, "$", "string"))


def shown(variant: Column) -> Column:
    """The text of a string, the JSON of anything else."""
    return F.coalesce(string_of(variant), F.to_json(variant))


def text_field(text: Column, name: str) -> Column:
    """A member that is a JSON string; NULL for other types, where it is absent or the text does not parse."""
    return let(text, lambda x: let(strict_variant(x), lambda v: F.when(is_strict(v, x), _string_member(v, name))))


def typed(text: Column, schema: T.StructType) -> Column:
    """Parsed struct, NULL where the text is not an object.

    The parse stays in one piece: column pruning would otherwise repeat it for every field.
    """

    def parsed(x):
        return F.when(is_strict(strict_variant(x), x) & opens_object(x), F.from_json(x, schema))

    return let(text, parsed)
