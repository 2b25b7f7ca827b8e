"""Prompts of the merge model, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze

# Names of languages, names and texts of the instructions, and the aliases of the first one.
LANGUAGES = {"ru": "Russian", "uk": "Ukrainian", "en": "English"}
DEFAULT = "baseline_v1"
ALIASES = {"default": DEFAULT, "baseline": DEFAULT}
INSTRUCTIONS = {
    "baseline_v1": """Rules:
- Start from Canary and keep its structure unless a concrete correction is justified.
- Use CTC as the main truth source for specific word and meaning corrections.
- Use Whisper only as an auxiliary hint when Canary and CTC remain ambiguous.
- Make the smallest possible edit. Do not rephrase, summarize, or add unsupported words.
- Output corrected transcript text only. No commentary.""",
    "priority_ladder_v1": """Rules:
- Treat Canary as the default answer and preserve its wording when evidence is weak.
- Apply a correction only when CTC provides a clearer same-language lexical fix.
- Use Whisper only as a tie-breaker between Canary and CTC; never let Whisper overrule both.
- Prefer one local correction over rewriting the full segment.
- Output corrected transcript text only. No commentary.""",
    "consensus_gate_v1": """Decision procedure:
- Start from Canary.
- Change Canary only if at least one gate passes: (1) CTC and Whisper agree on the correction; (2) CTC clearly repairs a garbled or missing same-language word; (3) Canary is foreign-language or obviously broken.
- If no gate passes, return Canary unchanged.
- Keep every accepted edit minimal and directly supported by the sources.
- Output corrected transcript text only. No commentary.""",
    "token_preservation_v1": """Editing policy:
- Act as a surgical transcript editor, not a paraphraser.
- Preserve token order, clause structure, and approximate length from Canary unless the anchor requires a fix.
- Replace only the smallest span that is directly supported by CTC.
- Keep punctuation and filler words unless the correction clearly changes them.
- Output corrected transcript text only. No commentary.""",
    "verification_checklist_v1": """Checklist before answering:
- The output must stay in the requested language and script.
- Every important content word must be supported by Canary, CTC, or Whisper.
- Do not add new facts, cleanup, or stylistic rewrites.
- If CTC looks fragmentary or low-information, keep Canary.
- If unsure after checking the sources, return Canary unchanged.
- Output corrected transcript text only. No commentary.""",
}


def resolved(name: str | None) -> tuple[str, str]:
    """The instructions that a name or alias, of any case, stands for."""
    key = (name or DEFAULT).strip().lower()
    key = ALIASES.get(key, key)
    if key not in INSTRUCTIONS:
        raise ValueError(f"no instructions {name!r}; there are {', '.join(sorted(INSTRUCTIONS))}")
    return key, INSTRUCTIONS[key]


def language_name(language: Column) -> Column:
    code = F.lower(F.coalesce(language, F.lit("")))
    named = F.coalesce(*(F.when(code == k, v) for k, v in LANGUAGES.items()))
    return F.coalesce(named, F.nullif(language, F.lit("")), F.lit("LANGUAGE"))


def prompts(requests: DataFrame, language: Column, model: str, variant: str | None = None, custom: str | None = None) -> DataFrame:
    """Requests with ``prompt`` and ``payload``, the JSON of a deterministic model call; empty texts are marked.

    custom: instructions of one's own instead of the named ones.
    """
    name, rules = ("custom", " ".join(custom.split())) if custom is not None else resolved(variant)
    shown = lambda c: F.when(squeeze(F.col(c)) == "", "[empty]").otherwise(F.col(c))
    lines = [
        F.concat(F.lit("You are correcting one "), language_name(language), F.lit(" transcript segment.")), F.lit("Goal: produce the final transcript text for exactly this segment."),
        F.concat(F.lit("Base transcript [Canary]: "), shown("canary_text")), F.concat(F.lit("Truth anchor [CTC]: "), shown("ctc_text")), F.concat(F.lit("Auxiliary transcript [Whisper]: "), shown("whisper_text")),
        F.lit(f"Instruction profile [{name}]:"), F.lit(rules), F.concat(F.lit("Output corrected "), language_name(language), F.lit(" only. No commentary.")),
    ]
    options = F.struct(F.lit(0).alias("temperature"), F.lit(1).alias("top_k"), F.lit(96).alias("num_predict"))
    call = F.struct(F.lit(model).alias("model"), F.col("prompt"), F.lit(False).alias("stream"), F.lit(False).alias("think"), options.alias("options"))
    return requests.withColumn("prompt", F.concat_ws("\n", *lines)).withColumn("payload", F.to_json(call))
