"""Column functions on ids, texts and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankspark import schemas

#: Characters of a word that is cut back to, at least, as a share of the limit.
KEEP_WORD = 0.7
LADDER = (150, 120, 100, 80, 60, 40)
DEFAULT_INSTRUCTION = "You are a helpful assistant."


def strip(text: Column) -> Column:
    """Without white space at both ends, line feeds and tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def norm_id(x: Column) -> Column:
    """A path with single slashes and no `.` steps, and no dots or slashes at its start."""
    folded = F.regexp_replace(x.cast("string"), r"/+(\./+)*", "/")
    return F.regexp_replace(F.regexp_replace(folded, r"(.)/(\.)?$", "$1"), r"^[./]+", "")


def base_key_of_passage(passage_id: Column) -> Column:
    """The hexadecimal key of `.../<key>_<n>.txt`; other ids stay as they are."""
    return F.coalesce(F.nullif(F.regexp_extract(passage_id, r"/([0-9a-f]+)_\d+\.txt$", 1), F.lit("")), passage_id)


def base_key_of_image(path: Column, domain: Column) -> Column:
    r"""The key of `<domain>_<key>_<n>` in a path, or an empty string; the domain is taken literally."""
    quoted = F.concat(F.lit(r"\Q"), domain, F.lit(r"\E_([0-9a-f]+)_\d+"))
    return F.call_function("regexp_extract", path, quoted, F.lit(1))


def pair_id(base_id: Column, image: Column) -> Column:
    return F.concat_ws(schemas.PAIR_SEPARATOR, base_id, F.coalesce(image, F.lit(schemas.NO_IMAGE)))


def pair_base(doc_id: Column) -> Column:
    return F.substring_index(doc_id, schemas.PAIR_SEPARATOR, 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def tokens(text: Column) -> Column:
    """The simple analyzer: lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def cut_tokens(text: Column, limit: int) -> Column:
    """The first `limit` blank-separated tokens, where there are more."""
    parts = F.split(text, " ")
    return F.when(F.size(parts) > limit, F.array_join(F.slice(parts, 1, limit), " ")).otherwise(text)


def truncate(text: Column, limit: int) -> Column:
    """The first code points."""
    return F.substring(text, 1, limit)


def truncate_at_word(text: Column, limit: int) -> Column:
    """At most `limit` code points; cut back to the last blank if that is beyond 70 % of the limit."""
    whole = strip(text)
    head = F.substring(whole, 1, limit)
    blank = F.when(F.instr(F.reverse(head), " ") > 0, F.length(head) - F.instr(F.reverse(head), " ")).otherwise(F.lit(-1))
    cut = F.when(blank > F.lit(limit * KEEP_WORD), F.substr(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(whole) > limit, strip(cut)).otherwise(whole)


def truncate_ladder(text: Column, fits, ladder: tuple[int, ...] = LADDER, last: str = "document") -> Column:
    """The longest truncation of the ladder that fits (a test of a Column); beneath 5 characters the first 40 are used.

    If none fits, the first 20 characters; if these are under 3, a constant.
    """
    short = strip(truncate(text, 20))
    out = F.when(F.length(short) < 3, F.lit(last)).otherwise(short)
    for limit in reversed(ladder):
        cut = truncate_at_word(text, limit)
        cut = F.when(F.length(strip(cut)) < 5, strip(truncate(text, 40))).otherwise(cut)
        out = F.when(fits(cut), cut).otherwise(out)
    return out


def blank_guard(text: Column, instead: str = " ") -> Column:
    return F.when(text.isNull() | (strip(text) == ""), F.lit(instead)).otherwise(text)


def instruct(text: Column, instruction: Column | str, task: Column) -> Column:
    """The instruction with {task} and, if it is there, {query} filled in; without {query} the text follows it."""
    instruction = F.lit(instruction) if isinstance(instruction, str) else instruction
    filled = F.replace(instruction, F.lit("{task}"), task)
    return F.when(instruction.contains("{query}"), F.replace(filled, F.lit("{query}"), text)).otherwise(F.concat(filled, text))


def instruct_pair(text: Column, instruction: str) -> Column:
    return F.array(F.lit(instruction), text)


def prompt(text: Column, kind: str, has_image: Column | None = None) -> Column:
    """Texts as models of a kind want them. The prefixes and suffixes."""
    plain = {"search": ("search_query: ", ""), "represent": ("Represent this text:", ""), "document": ("Document: ", ""), "document_eos": ("document: ", "<eos>"), "query_eos": ("query: ", "<eos>")}
    if kind in plain:
        before, after = plain[kind]
        return F.concat(F.lit(before), text, F.lit(after))
    if kind == "chat_image":
        image = F.when(has_image, F.lit("<image>\n")).otherwise(F.lit("")) if has_image is not None else F.lit("")
        return F.concat(F.lit("USER: "), image, text, F.lit("\nASSISTANT:"))
    raise ValueError(f"unknown kind {kind}")


def instruct_query(text: Column, task: str) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery:"), text)


def chat(text: Column, has_image: Column, instruction: Column | None = None) -> Column:
    """A chat message with an optional image. The markup."""
    system = F.coalesce(instruction, F.lit(DEFAULT_INSTRUCTION)) if instruction is not None else F.lit(DEFAULT_INSTRUCTION)
    image = F.when(has_image, F.lit("<|vision_start|><|image_pad|><|vision_end|>")).otherwise(F.lit(""))
    parts = [F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), image, F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n<|im_start|>assistant\n<|endoftext|>")]
    return F.concat(*parts)


def fill_template(text: Column, has_image: Column, is_query: bool, instruction: str | None = None, prefix: str = "Query: ") -> Column:
    """`<image>` and `<text>` filled in; the image's line goes where there is none."""
    head = (f"Instruct: {instruction}\n{prefix}" if instruction is not None else prefix) if is_query else ""
    kept = F.when(has_image, F.lit(f"{head}<image>\n<text>")).otherwise(F.lit(f"{head}<text>"))
    return F.replace(kept, F.lit("<text>"), F.coalesce(text, F.lit("")))


def instruction_length(prompt_: Column, prefix: str = "Query: ", image_tokens: int = 576) -> Column:
    """Blank-separated tokens before the prefix, an image counting as so many; 0 without the prefix."""
    before = F.substring_index(prompt_, prefix, 1)
    n = F.size(F.filter(F.split(before, r"\s+"), lambda t: t != ""))
    n = n + F.when(before.contains("<image>"), F.lit(image_tokens - 1)).otherwise(F.lit(0))
    return F.when(prompt_.contains(prefix), n).otherwise(F.lit(0))


def signature(*parts: Column) -> Column:
    """md5 of parts joined by a bar: the key of a derived file."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
