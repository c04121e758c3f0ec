"""Schemas and profiles: what is specific to a dataset, a script, a label set or a site is data here."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# The canonical columns, in order.
ARTICLE_COLUMNS = ["website", "article_url", "language", "headline", "article_text"]
EMOTIONS = ["joy", "sadness", "anger", "fear", "disgust", "surprise", "neutral"]
EMOTION_COLUMNS = [f"ekman_{e}" for e in EMOTIONS]
SENTIMENTS = ["positive", "negative", "neutral"]

ARTICLE = strings(*ARTICLE_COLUMNS)
ANNOTATION = T.StructType(
    [T.StructField("summary", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in EMOTION_COLUMNS), T.StructField("dominant_emotion", T.StringType()), T.StructField("sentiment", T.StringType())]
)
PREDICTION = T.StructType([*(T.StructField(c, T.DoubleType()) for c in EMOTION_COLUMNS), T.StructField("dominant_emotion", T.StringType()), T.StructField("pred_sentiment", T.StringType())])
GENERATION = strings("row_key", "generated")
# Fields of metric files, in both generations of them.
CONFUSION = "struct<labels:array<string>,matrix:array<array<bigint>>>"
PER_CLASS = "map<string,struct<precision:double,recall:double,`f1-score`:double,support:double>>"
SCORES = ["emo_acc", "emo_macro_precision", "emo_macro_recall", "emo_macro_f1", "emo_weighted_f1", "emo_kappa", "emo_mean_js", "sent_acc", "sent_macro_precision", "sent_macro_recall", "sent_macro_f1", "sent_weighted_f1", "sent_kappa"]
OLDER_SCORES = ["emo_preserved_acc", "emo_weighted_precision", "emo_weighted_recall", "sent_preserved_acc", "sent_weighted_precision", "sent_weighted_recall", "sent_polarity_flip_rate"]
SLICE = (
    "struct<task:string,language:string,provider:string,model:string,n_scored:bigint,n_missing:bigint,"
    + ",".join(f"{c}:double" for c in SCORES + OLDER_SCORES)
    + f",emotion_confusion_matrix:{CONFUSION},sentiment_confusion_matrix:{CONFUSION},emotion_per_class:{PER_CLASS},sentiment_per_class:{PER_CLASS}>"
)


@dataclass(frozen=True)
class ScriptProfile:
    """A script as the inside of a regular-expression class, for Java and RE2 alike."""

    name: str
    chars: str


DEVANAGARI = ScriptProfile("devanagari", r"\x{0900}-\x{097F}\x{1CD0}-\x{1CFF}\x{A8E0}-\x{A8FF}")
DEVANAGARI_BASE = ScriptProfile("devanagari_base", r"\x{0900}-\x{097F}")
LATIN = ScriptProfile("latin", "A-Za-z")
LATIN_ACCENTED = ScriptProfile("latin_accented", r"A-Za-z\x{00C0}-\x{024F}")


@dataclass(frozen=True)
class LanguageMarkers:
    """Marker lists of a primary and a foreign language, and the names of the three outcomes."""

    primary: tuple[str, ...]
    foreign: tuple[str, ...]
    names: tuple[str, str, str] = ("primary", "foreign", "mixed")
    foreign_from: float = 0.60
    mixed_from: float = 0.20


# Marker strings of Maithili and Hindi; a trailing blank or mark belongs to the marker.
MAITHILI_HINDI = LanguageMarkers(
    primary=(
        "अछि", "छथि", "छलाह", "छल ", "छल।", "छल,", "केँ ", "सँ ", "मे ", "कऽ ", "लऽ ",
        "जाइत", "होइत", "रहैत", "करैत", "बनैत", "छैक", "छनि", "छियनि", "छियैक", "अछनि",
        "कहलनि", "देलनि", "भेलनि", "गेलनि", "भेल ", "भेल।", "गेल ", "गेल।", "ओतय", "एतय", "जतय", "कतय",
        "आयल", "गेलाह", "कएल", "लेल ", "तखन", "एखन", "किएक", "कियैक", "हुनका", "हमरा", "अपना", "तोहर",
    ),
    foreign=(
        "नहीं", "करते", "होते", "जाते", "आते", "जाता", "हैं ", "हैं।", "हैं,", "था ", "था।", "था,", "थे ", "थे।", "थी ", "थी।",
        "होगा", "करेगा", "जाएगा", "होंगे", "करेंगे", "जाएंगे", "रहे हैं", "रहा है", "रही है", "किया ", "किया।", "किया,",
        "लेकिन", "बल्कि", "इसलिए", "क्योंकि", "उनका", "उनकी", "उनके", "उन्हें", "इसका", "इसकी", "इसके", "इसमें",
        "यहां", "वहां", "जहां", "कहां", "करना", "होना", "जाना", "आना",
    ),
    names=("Maithili", "Hindi", "Maithili-Hindi Mixed"),
)
# Words that open a submission header.
PREAMBLE_WORDS = ("लेख विचार प्रेषित", "साप्ताहिक गतिविधि", "वृहस्पतिवार", "बृहस्पतिवार")


@dataclass(frozen=True)
class DatasetProfile:
    """How a source table's columns map to the canonical ones."""

    name: str
    renames: dict[str, str] = field(default_factory=dict)


DATASETS = {
    p.name: p
    for p in (
        DatasetProfile("bhojpuri_1"),
        DatasetProfile("bhojpuri_2"),
        DatasetProfile("maithili_1", {"article_link": "article_url", "article_language": "language", "article_headline": "headline"}),
        DatasetProfile("maithili_2"),
    )
}
# Names under which evaluation tables carry their text columns.
ALIASES = {
    "article_text": ["article_text", "text", "article", "body", "content"],
    "summary": ["summary", "gold_summary", "reference_summary"],
    "headline": ["headline", "article_headline", "title"],
}


@dataclass(frozen=True)
class SiteProfile:
    """How one site's pages hold an article: containers in order of preference, and what to prune from them."""

    containers: tuple[tuple[str, str], ...] = (("div", "entry-content"), ("div", "post-content"), ("article", ""), ("div", "content|post|article"))
    prune_tags: tuple[str, ...] = ("nav", "aside", "footer", "script", "style", "button", "form", "iframe", "noscript")
    prune_classes: str = "sharedaddy|post-tags|related|comment|breadcrumb|pagination|nav|sidebar|widget"
    title_suffixes: tuple[str, ...] = ()
    least_chars: int = 0
    paragraphs: bool = True


# Containers and pruned classes of the supported sites.
SITES = {
    "maithilijindabaad": SiteProfile(title_suffixes=(" - मैथिली जिन्दाबाद", " – मैथिली जिन्दाबाद", "- मैथिली जिन्दाबाद", "– मैथिली जिन्दाबाद"), paragraphs=False),
    "anjoria": SiteProfile(
        (("div", "et_pb_post_content"), ("div", "td-post-content"), ("div", "entry-content"), ("div", "post-content"), ("div", "article-content")),
        ("figcaption", "script", "style"),
        "related|sharedaddy|jp-relatedposts|post-related|yarpp|wpcnt|share|social|subscribe|newsletter|comment|wp-caption|wp-block-image|et_pb_image|aligncenter|alignleft|alignright|gallery",
        least_chars=300,
    ),
    "khabarbhojpuri": SiteProfile((("div", "entry-content|post-content|article-content|content-area"), ("article", ""), ("div", "post")), ("script", "style"), "(?!)", (" - ",), 200),
    "sitemap": SiteProfile((("div", "entry-content"), ("div", "post-content"), ("div", "td-post-content"), ("article", "")), ("form", "textarea", "input", "script", "style"), "comment", least_chars=100),
}
