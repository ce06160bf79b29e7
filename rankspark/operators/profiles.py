"""How known retrieval models want their inputs: text treatment, comparison, exclusion and missing images, by task.

A profile has no weights. With an encoder registered under the same name (`encoders.register`), or passed in, it makes a
model; what differs between models beyond the encoder is stated here, in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankspark.functions import text as T

TASKS = ("text_text", "multimodal_text", "text_image", "text_pair")
#: When excluded documents go, by task.
EXCLUSION = {"text_text": "before", "multimodal_text": "before", "text_image": "after", "text_pair": "mask"}


@dataclass(frozen=True)
class Profile:
    """query and document: steps that are applied in order. Steps: instruct; cut:<tokens>; chars:<code points>;
    word:<code points>; blank:<text>; prompt:<kind>."""

    query: tuple[str, ...] = ()
    document: tuple[str, ...] = ()
    normalise: bool = True
    #: What a text without an image is fused with: blank, zero, or text (not fused at all); joint encoders take both.
    missing_image: dict[str, str] = field(default_factory=dict)
    joint: bool = False


#: Settings of the models by task and key.
PROFILES: dict[str, dict[str, Profile]] = {
    "text_text": {
        **{k: Profile(("instruct",)) for k in ("sf", "qwen", "qwen2", "e5", "m2", "bge")},
        "sbert": Profile(),
        **{k: Profile(("instruct",), ("instruct",)) for k in ("inst-l", "inst-xl", "grit", "reasonir")},
        "openai": Profile(("cut:6000", "blank: "), ("cut:6000", "blank: ")),
        "cohere": Profile(normalise=False),
        "voyage": Profile(("cut:16000",), ("cut:16000",)),
        "google": Profile(("blank:empty",), ("blank:empty",)),
        "diver-retriever": Profile(("instruct",), ("prompt:represent",)),
        "contriever": Profile(),
        "rader": Profile(("chars:8192", "prompt:query_eos"), ("chars:8192", "prompt:document_eos")),
        "nomic": Profile(),
        "hashing": Profile(),
    },
    "multimodal_text": {
        "clip": Profile(("cut:77",), ("cut:77",), missing_image={"query": "blank"}),
        "siglip": Profile(missing_image={"query": "blank"}),
        "jina-clip": Profile(missing_image={"query": "zero"}),
        "nomic-vision": Profile(("chars:8000", "prompt:search"), ("chars:8000",), missing_image={"query": "text"}),
        **{k: Profile(("word:150",), ("word:150",), joint=True) for k in ("bge-vl-base", "bge-vl-large")},
        **{k: Profile(("chars:4000",), ("chars:4000",), joint=True) for k in ("gme-qwen2-vl-2b", "gme-qwen2-vl-7b")},
        "hashing": Profile(missing_image={"query": "text"}),
    },
    "text_image": {
        "clip": Profile(("cut:77",), missing_image={"query": "blank"}),
        "siglip": Profile(missing_image={"query": "blank"}),
        "jina-clip": Profile(missing_image={"query": "zero"}),
        "nomic-vision": Profile(("prompt:search",), missing_image={"query": "blank"}),
        "bge-vl-large": Profile(("word:150",), missing_image={"query": "text"}),
        **{k: Profile(("chars:4000",), joint=True) for k in ("gme-qwen2-vl-2b", "gme-qwen2-vl-7b")},
        "hashing": Profile(missing_image={"query": "text"}),
    },
    "text_pair": {
        "clip": Profile(("cut:77",), ("cut:77",), missing_image={"query": "blank", "document": "blank"}),
        "siglip": Profile(missing_image={"query": "blank", "document": "blank"}),
        "jina-clip": Profile(missing_image={"query": "blank", "document": "blank"}),
        "bge-vl-large": Profile(("word:150",), ("word:150",), joint=True),
        **{k: Profile(("chars:4000",), ("chars:4000",), joint=True) for k in ("gme-qwen2-vl-2b", "gme-qwen2-vl-7b")},
        "nomic-vision": Profile(("chars:8000", "prompt:search"), ("chars:8000",), missing_image={"query": "zero", "document": "zero"}),
        "hashing": Profile(missing_image={"query": "text", "document": "text"}),
    },
}
#: Models that score terms, not vectors.
LEXICAL = {"text_text": ("bm25",)}


def names(task: str) -> list[str]:
    return sorted([*PROFILES[task], *LEXICAL.get(task, ())])


def prepare(text: Column, steps: tuple[str, ...], instruction: str = "", domain: Column | None = None) -> Column:
    """The text as the steps leave it; an empty instruction adds nothing."""
    for step in steps:
        name, _, value = step.partition(":")
        if name == "instruct":
            text = T.instruct(text, instruction, domain if domain is not None else F.lit("")) if instruction else text
        elif name == "cut":
            text = T.cut_tokens(text, int(value))
        elif name == "chars":
            text = T.truncate(text, int(value))
        elif name == "word":
            text = T.truncate_at_word(text, int(value))
        elif name == "blank":
            text = T.blank_guard(text, value)
        elif name == "prompt":
            text = T.prompt(text, value)
        else:
            raise ValueError(f"unknown step {step}")
    return text
