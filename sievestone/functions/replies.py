"""Model replies to typed values, in Column expressions: JSON out of chatter, emotion vectors, sentiments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EMOTION_COLUMNS, EMOTIONS, SENTIMENTS
from .text import bound, capitalize, col, strip_ws


def unfence(c: Column | str) -> Column:
    """Without a fence: the first line if it opens one, the last if it is one."""
    inside = lambda text: strip_ws(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", ""))
    return bound(strip_ws(c), lambda text: F.when(F.startswith(text, F.lit("```")), inside(text)).otherwise(text))


def extract_json(c: Column | str, hint: str = "") -> Column:
    """The first flat object with the hint, else the last flat object, else from the first to the last brace, else all."""

    def of(text: Column) -> Column:
        greedy = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
        hinted = lambda flat: F.try_element_at(F.filter(flat, lambda x: F.contains(x, F.lit(hint))), F.lit(1)) if hint else F.lit(None).cast("string")
        flat = F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1)
        return F.coalesce(bound(flat, lambda x: F.coalesce(hinted(x), F.try_element_at(x, F.lit(-1)))), greedy, text)

    return bound(F.regexp_replace(F.regexp_replace(strip_ws(c), r"(?is)<think>.*?</think>", " "), "```(?:json)?", " "), of)


def normalize_vector(v: Column, digits: int = 4) -> Column:
    """Divided by its sum and rounded, so that it may miss 1 by a little; null unless the sum is positive."""
    divided = lambda w, total: F.when(total > 0, F.transform(w, lambda x: F.round(x / total, digits)))
    return bound(v, lambda w: bound(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda total: divided(w, total)))


def dominant_label(v: Column, labels: list[str]) -> Column:
    """The label of the first maximum."""
    return bound(v, lambda w: F.get(F.array(*map(F.lit, labels)), F.array_position(w, F.array_max(w)).cast("int") - 1))


def one_hot(label: Column, labels: list[str]) -> Column:
    return F.array(*[F.when(label == x, 1.0).otherwise(0.0) for x in labels])


def _scores(json: Column) -> Column:
    """The seven scores, null if one is missing or no number."""
    values = F.array(*[F.get_json_object(json, f"$.{k}").try_cast("double") for k in EMOTION_COLUMNS])
    return bound(values, lambda v: F.when(~F.exists(v, F.isnull), v))


def _vector(v: Column) -> Column:
    return bound(v, lambda w: F.struct(w.alias("scores"), dominant_label(w, EMOTIONS).alias("dominant_emotion")))


def parse_annotated_emotion(c: Column | str) -> Column:
    """struct(scores, dominant_emotion); anything missing or wrong: all neutral."""
    neutral = one_hot(F.lit("neutral"), EMOTIONS)
    stated = lambda json: F.when(F.get_json_object(json, "$.dominant_emotion").isNotNull(), normalize_vector(_scores(json)))
    return _vector(F.coalesce(bound(unfence(c), stated), neutral))


def parse_classified_emotion(c: Column | str) -> Column:
    """struct(scores, dominant_emotion); null scores if wrong. All-zero scores: the stated label alone."""

    def of(json: Column) -> Column:
        alone = bound(F.lower(strip_ws(F.get_json_object(json, "$.dominant_emotion"))), lambda stated: F.when(stated.isin(EMOTIONS), one_hot(stated, EMOTIONS)))
        return bound(_scores(json), lambda scores: F.coalesce(normalize_vector(scores), F.when(scores.isNotNull(), alone)))

    return _vector(bound(extract_json(c, "ekman_joy"), of))


def parse_sentiment(c: Column | str, policy: str = "annotate") -> Column:
    """annotate: capitalised, else Neutral; exact: as written, else Neutral; classify: lower case, else null."""
    names = [s.capitalize() for s in SENTIMENTS]
    if policy == "classify":
        label = F.lower(strip_ws(F.get_json_object(extract_json(c, "sentiment"), "$.sentiment")))
        return bound(label, lambda x: F.when(x.isin(SENTIMENTS), x))
    label = strip_ws(F.get_json_object(unfence(c), "$.sentiment"))
    label = capitalize(label) if policy == "annotate" else label
    return bound(label, lambda x: F.when(x.isin(names), x).otherwise("Neutral"))


def is_sentiment_missing(c: Column | str) -> Column:
    return ~F.coalesce(col(c), F.lit("")).isin([s.capitalize() for s in SENTIMENTS])


def accept_annotation(summary: Column, emotion: Column) -> Column:
    """False for a failed row: an empty summary along with the neutral fallback."""
    return ~((F.coalesce(summary, F.lit("")) == "") & (emotion["dominant_emotion"] == "neutral") & (F.element_at(emotion["scores"], -1) == 1.0))


def accept_classification(emotion: Column, sentiment: Column) -> Column:
    return emotion["scores"].isNotNull() & sentiment.isNotNull()


def is_complete(summary: Column, emotion: Column, sentiment: Column) -> Column:
    """A row fit for export: a summary that isn't blank, an emotion that isn't the neutral fallback, a known sentiment."""
    fallback = (emotion["dominant_emotion"] == "neutral") & (F.element_at(emotion["scores"], -1) == 1.0)
    own = (strip_ws(F.coalesce(summary, F.lit(""))) != "") & ~F.coalesce(fallback, F.lit(True))
    return own & ~is_sentiment_missing(sentiment)
