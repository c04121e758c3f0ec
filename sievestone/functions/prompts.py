"""Prompts and model specifications as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, truncate

# Providers that can prefix a model's name.
PROVIDERS = ["groq", "openrouter", "nvidia", "sambanova"]
# Options by provider and by what a model's name holds.
OPTIONS = {("groq", "qwen3"): '{"reasoning_effort":"none"}', ("groq", "gpt-oss"): '{"reasoning_effort":"low"}', ("openrouter", "gpt-oss"): '{"reasoning":{"effort":"low"}}', ("openrouter", "qwen3"): '{"reasoning":{"enabled":false}}'}
# The models by key, with their architecture and the form of their prompts.
MODELS = [
    ("airavata", "ai4bharat/Airavata", "causal", "airavata"),
    ("sarvam1", "sarvamai/sarvam-1", "causal", "plain"),
    ("openhathi", "sarvamai/OpenHathi-7B-Hi-v0.1-Base", "causal", "plain"),
    ("llama31", "meta-llama/Llama-3.1-8B-Instruct", "causal", "chat_sys"),
    ("gemma2", "google/gemma-2-9b-it", "causal", "chat_nosys"),
    ("indicbart_pre", "ai4bharat/IndicBART", "seq2seq", "none"),
]
# The models' protocol.
PROTOCOL = {"shots": 0, "num_beams": 4, "length_penalty": 1.0, "no_repeat_ngram_size": 3, "max_input_tokens": 1024, "seed": 42}


def render(template: str, **values: Column) -> Column:
    """The template with {name} replaced by each value, in one pass: braces in a value stay as they are."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def article_prompt(template: str, text: Column | str, limit: int = 6000, **values: Column) -> Column:
    return render(template, text=truncate(text, limit), **values)


def instruction(paragraphs: Column, bullets: Column) -> Column:
    """Paragraphs joined by blank lines, then bullets a line each."""
    return F.concat(F.array_join(paragraphs, "\n\n"), F.when(F.size(bullets) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n"))).otherwise(""))


def chat_format(kind: Column | str, system: Column, user: Column, body: Column) -> Column:
    """The prompt in the model's form; templates with roles are given as JSON messages. Unknown kinds are null."""
    message = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    k = col(kind)
    return (
        F.when(k == "airavata", F.concat(F.lit("<|system|>\n"), system, F.lit("\n<|user|>\n"), user, F.lit("\n<|assistant|>\n")))
        .when(k == "plain", F.concat(system, F.lit("\n\n"), user))
        .when(k == "chat_sys", F.to_json(F.array(message("system", system), message("user", user))))
        .when(k == "chat_nosys", F.to_json(F.array(message("user", F.concat(system, F.lit("\n\n"), user)))))
        .when(k == "none", F.concat(F.lit("<2hi> "), body, F.lit(" </s>")))
    )


def prompt_checksum(system: Column, instruction_: Column) -> Column:
    return F.substring(F.sha1(F.encode(F.concat(system, instruction_), "UTF-8")), 1, 16)


def verified_checksum(system: Column, instruction_: Column, recorded: Column) -> Column:
    """struct(recorded, computed, matches): a mismatch is told, not raised."""
    own = prompt_checksum(system, instruction_)
    return F.struct(recorded.alias("recorded"), own.alias("computed"), (own == recorded).alias("matches"))


def parse_model_spec(c: Column | str, default: str = "groq") -> Column:
    """struct(provider, model) of ``provider:model``; only known providers are prefixes."""
    head = F.split_part(col(c), F.lit(":"), F.lit(1))
    known = F.contains(col(c), F.lit(":")) & head.isin(PROVIDERS)
    return F.struct(F.when(known, head).otherwise(F.lit(default)).alias("provider"), F.when(known, F.substring(col(c), F.length(head) + 2, F.length(col(c)))).otherwise(col(c)).alias("model"))


def provider_options(provider: Column, model: Column) -> Column:
    found = None
    for (p, part), options in OPTIONS.items():
        holds = (provider == p) & F.contains(F.lower(model), F.lit(part))
        found = F.when(holds, options) if found is None else found.when(holds, options)
    return found.otherwise(F.lit("{}"))


def registered(key: Column | str) -> Column:
    """struct(model, architecture, format) of a model's key; null for an unknown one."""
    found = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.struct(*[F.lit(x).alias(n) for x, n in zip(own, ("model", "architecture", "format"), strict=True)])) for k, *own in MODELS]))
    return F.try_element_at(found, col(key))
