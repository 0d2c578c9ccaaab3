"""Column factories for names, values and rule texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of truth values, rule-text templates and action words.
TRUE_WORDS = ("y", "yes", "t", "true", "on", "1")
FALSE_WORDS = ("n", "no", "f", "false", "off", "0")
ACTIONS = ("undefined", "increase incrementally", "decrease incrementally", "adjust incrementally", "set", "adjust hardware")
SENTENCE = "If you encounter %s in [%.2f, %.2f], try to %s the parameter %s"
OLD_SENTENCE = "If you encounter %s, try to %s the parameter %s"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def camel_to_snake(c) -> Column:
    """underExtrusion -> under_extrusion."""
    split_words = F.regexp_replace(col(c), "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(split_words, "([a-z0-9])([A-Z])", "$1_$2"))


def rating_to_snake(c) -> Column:
    """As camel_to_snake, with ``overall`` named ``overall_ok``."""
    snake = camel_to_snake(c)
    return F.when(snake == "overall", F.lit("overall_ok")).otherwise(snake)


def snake_to_camel(c) -> Column:
    """under_extrusion -> underExtrusion."""
    parts = F.split(col(c), "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.initcap)
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def normalise(c) -> Column:
    """Lower case without spaces."""
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit(""))


def truth(c) -> Column:
    """Tolerant truth value of a text; NULL where it is none."""
    low = F.lower(F.trim(col(c)))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def typed_value(c) -> Column:
    """Text -> STRUCT(d, b, s): number first, then truth value; s keeps the text."""
    text = col(c)
    number = text.try_cast("double")
    finite = F.when(~F.isnan(number), number)
    return F.struct(finite.alias("d"), F.when(finite.isNull(), truth(text)).alias("b"), text.alias("s"))


def as_number(value: Column, code: Column | None = None) -> Column:
    """The numeric reading of a typed value: number, 0/1, else the category's code."""
    number = F.coalesce(value["d"], value["b"].cast("double"))
    return number if code is None else F.coalesce(number, code.cast("double"))


def value_kind(value: Column) -> Column:
    return F.when(value["d"].isNotNull(), "numeric").when(value["b"].isNotNull(), "boolean").when(value["s"].isNotNull(), "string")


def material_label(material_type, producer, color) -> Column:
    """Type, producer and colour joined by colons."""
    return F.concat_ws(":", col(material_type), col(producer), col(color))


def enum_name(c) -> Column:
    """``increase incrementally`` -> ``INCREASE_INCREMENTALLY``."""
    return F.upper(F.replace(F.trim(col(c)), F.lit(" "), F.lit("_")))


def edge_key(src, dst) -> Column:
    return F.to_json(F.array(col(src), col(dst)))


def iri(base: str, name) -> Column:
    return F.concat(F.lit(base), F.replace(F.url_encode(col(name)), F.lit("+"), F.lit("%20")))


def rule_text(r: str = "") -> Column:
    """Sentence of a rule with its condition range; ``r``: column prefix."""
    c = lambda n: F.col(f"{r}{n}")
    head = F.format_string(SENTENCE, c("condition"), c("cond_lo"), c("cond_hi"), c("action"), c("parameter"))
    return F.concat(head, _tail(c, lambda x: F.format_string("%.2f", x)))


def rule_text_old(r: str = "") -> Column:
    """The older sentence, without a condition range."""
    c = lambda n: F.col(f"{r}{n}")
    head = F.format_string(OLD_SENTENCE, c("condition"), c("action"), c("parameter"))
    return F.concat(head, _tail(c, lambda x: F.format_string("%.2f", x)))


def rule_key(r: str = "") -> Column:
    """Sentence with rounded numbers; identifies a rule."""
    c = lambda n: F.col(f"{r}{n}")
    head = F.concat_ws(" ", c("condition"), c("action"), c("parameter"), F.bround(c("cond_lo"), 2).cast("string"), F.bround(c("cond_hi"), 2).cast("string"))
    return F.concat(head, _tail(c, lambda x: F.bround(x, 2).cast("string")))


def _tail(c, number) -> Column:
    return (
        F.when(c("quantifier").isNotNull(), F.concat(F.lit(" to "), number(c("quantifier"))))
        .when(F.coalesce(c("step_size"), F.lit(0.0)) != 0, F.concat(F.lit(" by "), number(F.abs(c("step_size")))))
        .when(c("range_start").isNotNull(), F.concat(F.lit(" in range "), number(c("range_start")), F.lit(" to "), number(c("range_end"))))
        .otherwise(F.lit(""))
    )


NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"
_RULE = rf"^If you encounter (.+?)(?: in \[{NUMBER}, {NUMBER}\])?, try to ({'|'.join(ACTIONS)}) the parameter (.+?)(?: by {NUMBER}| in range {NUMBER} to {NUMBER}| to {NUMBER})?$"


def parse_rule(c) -> Column:
    """Sentence (either format) -> rule fields; a decrease has a negative step."""
    get = lambda i: F.nullif(F.regexp_extract(col(c), _RULE, i), F.lit(""))
    num = lambda i: get(i).cast("double")
    step = F.when(get(4) == "decrease incrementally", -num(6)).otherwise(num(6))
    return F.struct(
        get(1).alias("condition"), num(2).alias("cond_lo"), num(3).alias("cond_hi"), get(4).alias("action"), get(5).alias("parameter"),
        step.alias("step_size"), num(7).alias("range_start"), num(8).alias("range_end"), num(9).alias("quantifier"),
    )


def parse_range(c) -> Column:
    """``[a;b]``, ``<x`` and ``>x`` -> STRUCT(lo, hi) with open ends NULL."""
    both = rf"^\[\s*{NUMBER}\s*;\s*{NUMBER}\s*\]$"
    get = lambda p, i: F.nullif(F.regexp_extract(F.trim(col(c)), p, i), F.lit("")).cast("double")
    return F.struct(F.coalesce(get(both, 1), get(rf"^>\s*{NUMBER}$", 1)).alias("lo"), F.coalesce(get(both, 2), get(rf"^<\s*{NUMBER}$", 1)).alias("hi"))
