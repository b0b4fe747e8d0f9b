"""Judge prompts: padding, what is shown under each probe, template filling, rubric text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the filler of the padding probe, which says nothing about any answer.
PAD_TEXT = (
    "Additional background: The metric system was first adopted in France in 1795, and "
    "the meter was originally defined as one ten-millionth of the distance from the equator "
    "to the North Pole along a meridian. Over the following two centuries most countries "
    "adopted it for trade and science. Standard units have been redefined several times, "
    "most recently in 2019, when the kilogram, ampere, kelvin and mole were tied to fixed "
    "values of physical constants. Many everyday objects, from paper sizes to bottle volumes, "
    "follow metric conventions. This background is provided for completeness."
)
#: Variables of the rubric prompt that the promptfoo export keeps.
PROMPTFOO_VARIABLES = ("input", "context", "output", "expected_behavior", "criteria")


def pad(s: Column) -> Column:
    return F.concat(F.regexp_replace(s, r"(?U)\s+$", ""), F.lit("\n\n" + PAD_TEXT))


def presented(mode: Column, probe: Column, pad_side: Column, output: Column, other: Column) -> Column:
    """struct<output, answer_a, answer_b>: what a judge sees; the fields of the other mode are null."""
    none = F.lit(None).cast("string")
    a = F.when((probe == "pad") & (pad_side == "A"), pad(output)).otherwise(output)
    b = F.when((probe == "pad") & ~pad_side.eqNullSafe(F.lit("A")), pad(other)).otherwise(other)
    point = F.when(probe == "pad", pad(output)).otherwise(output)
    pair = mode == "pairwise"
    return F.struct(
        F.when(pair, none).otherwise(point).alias("output"),
        F.when(pair, F.when(probe == "swap", b).otherwise(a)).alias("answer_a"),
        F.when(pair, F.when(probe == "swap", a).otherwise(b)).alias("answer_b"),
    )


def render(template: Column, fields: dict[str, Column]) -> Column:
    """Literal {name} replaced field by field, in order; a null field leaves its name, an empty template gives null."""
    out = template
    for name, value in fields.items():
        out = F.coalesce(F.replace(out, F.lit("{" + name + "}"), value), out)
    return F.when(template != "", out)


def promptfoo_prompt(prompt: Column) -> Column:
    """A judge prompt for a Nunjucks template: variables as {{ name }}, all else in raw blocks."""
    names = r"\{(" + "|".join(PROMPTFOO_VARIABLES) + r")\}"
    raw = F.transform(F.split(prompt, names, -1), lambda p: F.when(p == "", "").otherwise(F.concat(F.lit("{% raw %}"), p, F.lit("{% endraw %}"))))
    variables = F.transform(F.regexp_extract_all(prompt, F.lit(names), F.lit(1)), lambda v: F.concat(F.lit("{{ "), v, F.lit(" }}")))
    return F.array_join(F.zip_with(raw, F.concat(variables, F.array(F.lit(""))), lambda x, y: F.concat(x, y)), "")


def prompt_hash(prompt: Column) -> Column:
    """The first 12 hexadecimal digits of a prompt's sha256, which tell judges' prompts apart in a run's files; null for null."""
    return F.substring(F.sha2(prompt.cast("string"), 256), 1, 12)
