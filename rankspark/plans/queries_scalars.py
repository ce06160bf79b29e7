"""Queries on column functions of ids, texts, prompts, vectors and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import images as I
from rankspark.functions import text as T
from rankspark.functions import vectors as V
from rankspark.plans.tables import table


def norm_id(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("./", "../.", "/", "a//b/./", "")]), (F.col("page_id") % 5 + 1).cast("int")), F.col("url"))
    return table(s, d, "pages").select("page_id", T.norm_id(raw).alias("id"))


def _keys(s: SparkSession, d: str) -> DataFrame:
    key = F.format_string("%08x", F.col("doc_id") * 7919)
    passage = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("en/"), key, F.lit(".txt"))).otherwise(F.concat(F.lit("en/"), key, F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    image = F.concat(F.lit("en/"), F.col("lang"), F.lit("_"), key, F.lit("_0002/image_1.webp"))
    return table(s, d, "documents").select("doc_id", "lang", passage.alias("passage"), image.alias("image"))


KEYS = "k AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN 'en/' || printf('%08x', doc_id * 7919) || '.txt' ELSE 'en/' || printf('%08x', doc_id * 7919) || '_' || CAST(doc_id AS VARCHAR) || '.txt' END AS passage, 'en/' || lang || '_' || printf('%08x', doc_id * 7919) || '_0002/image_1.webp' AS image FROM documents)"


def base_key_passage(s: SparkSession, d: str) -> DataFrame:
    return _keys(s, d).select("doc_id", T.base_key_of_passage(F.col("passage")).alias("base_key"))


def base_key_image(s: SparkSession, d: str) -> DataFrame:
    domain = F.when(F.col("doc_id") % 3 == 0, F.lit("xx")).otherwise(F.col("lang"))
    return _keys(s, d).select("doc_id", T.base_key_of_image(F.col("image"), domain).alias("base_key"))


def basename(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", T.basename(F.col("url")).alias("name"))


def cut_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.cut_tokens(F.col("text"), 40).alias("cut"))


def trunc_prefix(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", *[T.truncate(F.col("text"), n).alias(f"t{n}") for n in (2000, 4000, 8000, 8192)])


def trunc_word(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.truncate_at_word(F.col("text"), 150).alias("cut"))


def trunc_ladder(s: SparkSession, d: str) -> DataFrame:
    """A text fits if it has at most 16 tokens."""
    fits = lambda c: F.size(F.split(c, " ")) <= 16
    return table(s, d, "documents").select("doc_id", T.truncate_ladder(F.col("text"), fits).alias("cut"))


def blank_guard(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.lit(" \n\t ")).otherwise(F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", T.blank_guard(text, "empty").alias("text"))


def prompt_instruct(s: SparkSession, d: str) -> DataFrame:
    task = F.col("lang")
    return table(s, d, "documents").select("doc_id", T.instruct(F.col("text"), "Given a {task} question, find passages: ", task).alias("before"), T.instruct(F.col("text"), "Task {task}: <{query}>", task).alias("inside"))


def prompt_variants(s: SparkSession, d: str) -> DataFrame:
    kinds = ("search", "represent", "document", "document_eos", "query_eos")
    out = [T.prompt(F.col("text"), k).alias(k) for k in kinds]
    return table(s, d, "benchmark").select("item_id", *out, T.prompt(F.col("text"), "chat_image", F.col("item_id") % 2 == 0).alias("chat_image"), T.instruct_query(F.col("text"), "retrieve").alias("instruct"))


def prompt_chat(s: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("turn") % 2 == 0, F.col("role"))
    return table(s, d, "conversations").select("conv_id", "turn", T.chat(F.col("text"), F.col("turn") % 3 == 1, own).alias("message"))


def prompt_template(s: SparkSession, d: str) -> DataFrame:
    image = F.col("item_id") % 2 == 0
    text = F.when(F.col("item_id") % 5 == 0, F.lit(None)).otherwise(F.col("text"))
    return table(s, d, "benchmark").select("item_id", T.fill_template(text, image, True, "find").alias("query"), T.fill_template(text, image, True).alias("bare"), T.fill_template(text, image, False).alias("document"))


def instruction_length(s: SparkSession, d: str) -> DataFrame:
    prompt = F.concat(F.when(F.col("item_id") % 2 == 0, F.lit("Instruct: a <image> b\nQuery: ")).when(F.col("item_id") % 3 == 0, F.lit("Query: ")).otherwise(F.lit("")), F.col("text"))
    return table(s, d, "benchmark").select("item_id", T.instruction_length(prompt).cast("long").alias("n"))


def md5_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", T.signature(F.col("url"), F.length("html"), F.col("page_id")).alias("key"))


def uri_dispatch(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    uri = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("file://"), u)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("data:image/png;base64,"), F.base64(F.substring(F.encode(u, "utf-8"), 1, 30)))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("dir/"), u)).otherwise(u)
    return table(s, d, "pages").select("page_id", I.uri_kind(uri).alias("kind"), I.uri_payload(uri).alias("payload"))


def smart_resize(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    size = I.smart_resize(F.col("p_size") * F.col("p_partkey") % 6007 + 1, F.col("n") * 13 % 977 + 1)
    return table(s, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", size.alias("z")).select("p_partkey", "z.height", "z.width")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors, other lengths and a zero vector among them."""
    scale = F.when(F.col("vec_id") % 50 == 7, F.lit(0.0)).otherwise((F.col("vec_id") % 9 + 1).cast("double"))
    return table(s, d, "embeddings").select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale).alias("v"))


VECTORS = "e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * CASE WHEN vec_id % 50 = 7 THEN 0e0 ELSE CAST(vec_id % 9 + 1 AS DOUBLE) END) AS v FROM embeddings)"


def _rows(df: DataFrame, key: str, vector) -> DataFrame:
    """(key, pos, x): components as rows."""
    return df.select(key, F.posexplode(vector).alias("pos", "x")).select(key, F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def l2_normalize(s: SparkSession, d: str) -> DataFrame:
    e = _vectors(s, d)
    return _rows(e, "vec_id", V.l2_normalize(F.col("v"))).join(_rows(e, "vec_id", V.l2_normalize(F.col("v"), "add")).withColumnRenamed("x", "y"), ["vec_id", "pos"])


def layer_norm(s: SparkSession, d: str) -> DataFrame:
    return _rows(_vectors(s, d), "vec_id", V.layer_norm(F.col("v")))


def rms_norm(s: SparkSession, d: str) -> DataFrame:
    weight = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double") / 64)
    return _rows(_vectors(s, d), "vec_id", V.rms_norm(F.col("v"), weight))


def mean_pool(s: SparkSession, d: str) -> DataFrame:
    """Vectors of a label as tokens, those divisible by 4 masked."""
    e = _vectors(s, d).withColumn("mask", F.when(F.col("vec_id") % 4 == 0, 0).otherwise(1))
    return _rows(V.mean_pool(e, ["label"], "v", "mask"), "label", F.col("v"))


def last_pool(s: SparkSession, d: str) -> DataFrame:
    e = _vectors(s, d).withColumn("mask", F.when(F.col("vec_id") % 4 == 0, 0).otherwise(1))
    return _rows(V.last_pool(e, ["label"], "v", "vec_id", "mask"), "label", F.col("v"))


def first_pool(s: SparkSession, d: str) -> DataFrame:
    return _rows(V.first_pool(_vectors(s, d), ["label"], "v", "vec_id"), "label", F.col("v"))


def _fusable(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).withColumn("i", F.reverse("v")).withColumn("m", F.when(F.col("vec_id") % 3 == 0, F.lit(None)).otherwise(F.col("i")))


def fuse_mean(s: SparkSession, d: str) -> DataFrame:
    return _rows(_fusable(s, d), "vec_id", V.l2_normalize(V.fuse_mean(F.col("v"), F.col("i"))))


def fuse_weighted(s: SparkSession, d: str) -> DataFrame:
    return _rows(_fusable(s, d), "vec_id", V.fuse_weighted(F.col("v"), F.col("i")))


def fuse_missing(s: SparkSession, d: str) -> DataFrame:
    e = _fusable(s, d)
    blank = F.transform(F.col("v"), lambda x: F.lit(0.5))
    parts = [_rows(e, "vec_id", V.fuse_missing(F.col("v"), F.col("m"), p, blank)).withColumn("policy", F.lit(p)) for p in ("text", "zero", "blank")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rotate_half(s: SparkSession, d: str) -> DataFrame:
    return _rows(_vectors(s, d), "vec_id", V.rotate_half(F.col("v")))


def _mask(s: SparkSession, d: str) -> DataFrame:
    """A mask of 12 for each item, some zeros in front."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i < F.col("item_id") % 5, 0).otherwise(1))
    return table(s, d, "benchmark").select("item_id", mask.alias("mask"))


def pool_mask(s: SparkSession, d: str) -> DataFrame:
    out = V.pool_mask(F.col("mask"), (F.col("item_id") % 9).cast("int"))
    return _mask(s, d).select("item_id", F.posexplode(out).alias("pos", "x")).select("item_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("long").alias("x"))


def position_ids(s: SparkSession, d: str) -> DataFrame:
    return _mask(s, d).select("item_id", F.posexplode(V.position_ids(F.col("mask"))).alias("pos", "x")).select("item_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("long").alias("x"))


def cum_offsets(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return V.cumulative_offsets(c, ["conv_id"], "turn", "n")


QUERIES = {f.__name__: f for f in (norm_id, base_key_passage, base_key_image, basename, cut_tokens, trunc_prefix, trunc_word, trunc_ladder, blank_guard, prompt_instruct, prompt_variants, prompt_chat, prompt_template, instruction_length, md5_key, uri_dispatch, smart_resize, l2_normalize, layer_norm, rms_norm, mean_pool, last_pool, first_pool, fuse_mean, fuse_weighted, fuse_missing, rotate_half, pool_mask, position_ids, cum_offsets)}


def _sql_rows(vector: str, source: str, key: str = "vec_id", x: str = "x") -> str:
    return f"SELECT {key}, CAST(i - 1 AS BIGINT) AS pos, round(z[i], 6) + 0e0 AS {x} FROM (SELECT {key}, {vector} AS z FROM {source}), (SELECT unnest(range(1, 65)) AS i)"


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_NORM = "sqrt(list_dot_product(v, v))"


def _word_cut(text: str, limit: int) -> str:
    """SQL of the truncation at a word."""
    whole = _STRIP.format(text)
    head = f"substring({whole}, 1, {limit})"
    blank = f"(CASE WHEN instr(reverse({head}), ' ') > 0 THEN length({head}) - instr(reverse({head}), ' ') ELSE -1 END)"
    cut = f"CASE WHEN {blank} > CAST({limit * T.KEEP_WORD} AS DOUBLE) THEN substring({head}, 1, {blank}) ELSE {head} END"
    return f"CASE WHEN length({whole}) > {limit} THEN {_STRIP.format(f'({cut})')} ELSE {whole} END"


def _ladder_sql() -> str:
    cuts = []
    for n in T.LADDER:
        cut = f"({_word_cut('text', n)})"
        cuts.append(f"CASE WHEN length({_STRIP.format(cut)}) < 5 THEN {_STRIP.format('substring(text, 1, 40)')} ELSE {cut} END AS c{n}")
    last = _STRIP.format("substring(text, 1, 20)")
    pick = " ".join(f"WHEN len(string_split(c{n}, ' ')) <= 16 THEN c{n}" for n in T.LADDER)
    return f"SELECT doc_id, CASE {pick} WHEN length(z) < 3 THEN 'document' ELSE z END AS cut FROM (SELECT doc_id, {', '.join(cuts)}, {last} AS z FROM documents)"


_RESIZE = """WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey),
a AS (SELECT p_partkey, CAST(p_size * p_partkey % 6007 + 1 AS DOUBLE) AS h, CAST(n * 13 % 977 + 1 AS DOUBLE) AS w FROM part JOIN n ON p_partkey = l_partkey),
b AS (SELECT *, greatest(28, CAST(round_even(h / 28, 0) AS BIGINT) * 28) AS h1, greatest(28, CAST(round_even(w / 28, 0) AS BIGINT) * 28) AS w1 FROM a),
c AS (SELECT *, CASE WHEN h1 * w1 > 12845056 THEN CAST(floor(h / sqrt(h * w / 12845056e0) / 28) AS BIGINT) * 28 WHEN h1 * w1 < 3136 THEN CAST(ceil(h * sqrt(3136e0 / (h * w)) / 28) AS BIGINT) * 28 ELSE h1 END AS h2,
 CASE WHEN h1 * w1 > 12845056 THEN CAST(floor(w / sqrt(h * w / 12845056e0) / 28) AS BIGINT) * 28 WHEN h1 * w1 < 3136 THEN CAST(ceil(w * sqrt(3136e0 / (h * w)) / 28) AS BIGINT) * 28 ELSE w1 END AS w2 FROM b)
SELECT p_partkey, CAST(CASE WHEN greatest(h2, w2) / CAST(least(h2, w2) AS DOUBLE) > 200 AND h2 > w2 THEN w2 * 200 ELSE h2 END AS BIGINT) AS height, CAST(CASE WHEN greatest(h2, w2) / CAST(least(h2, w2) AS DOUBLE) > 200 AND h2 <= w2 THEN h2 * 200 ELSE w2 END AS BIGINT) AS width FROM c"""
_FUSED = "WITH {0}, f AS (SELECT vec_id, v, list_reverse(v) AS i FROM e)"
_CHAT = "'<|im_start|>system' || chr(10) || coalesce(CASE WHEN turn % 2 = 0 THEN role END, 'You are a helpful assistant.') || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || CASE WHEN turn % 3 = 1 THEN '<|vision_start|><|image_pad|><|vision_end|>' ELSE '' END || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<|endoftext|>'"
_FILL = "{0} || CASE WHEN item_id % 2 = 0 THEN '<image>' || chr(10) ELSE '' END || CASE WHEN item_id % 5 = 0 THEN '' ELSE text END"
ORACLES = {
    "norm_id": r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace((['./', '../.', '/', 'a//b/./', ''])[page_id % 5 + 1] || url, '/+(\./+)*', '/', 'g'), '(.)/(\.)?$', '\1'), '^[./]+', '') AS id FROM pages",
    "base_key_passage": f"WITH {KEYS} SELECT doc_id, coalesce(nullif(regexp_extract(passage, '/([0-9a-f]+)_\\d+\\.txt$', 1), ''), passage) AS base_key FROM k",
    "base_key_image": f"WITH {KEYS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE regexp_extract(image, '(en|fr|de|es)_([0-9a-f]+)_\\d+', 2) END AS base_key FROM k",
    "basename": "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages",
    "cut_tokens": "SELECT doc_id, CASE WHEN len(string_split(text, ' ')) > 40 THEN array_to_string(list_slice(string_split(text, ' '), 1, 40), ' ') ELSE text END AS cut FROM documents",
    "trunc_prefix": "SELECT doc_id, " + ", ".join(f"substring(text, 1, {n}) AS t{n}" for n in (2000, 4000, 8000, 8192)) + " FROM documents",
    "trunc_word": f"SELECT doc_id, {_word_cut('text', 150)} AS cut FROM documents",
    "trunc_ladder": _ladder_sql(),
    "blank_guard": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR regexp_full_match(text, '\\s*') THEN 'empty' ELSE text END AS text FROM conversations",
    "prompt_instruct": "SELECT doc_id, 'Given a ' || lang || ' question, find passages: ' || text AS before, 'Task ' || lang || ': <' || text || '>' AS inside FROM documents",
    "prompt_variants": "SELECT item_id, 'search_query: ' || text AS search, 'Represent this text:' || text AS represent, 'Document: ' || text AS document, 'document: ' || text || '<eos>' AS document_eos, 'query: ' || text || '<eos>' AS query_eos, 'USER: ' || CASE WHEN item_id % 2 = 0 THEN '<image>' || chr(10) ELSE '' END || text || chr(10) || 'ASSISTANT:' AS chat_image, 'Instruct: retrieve' || chr(10) || 'Query:' || text AS instruct FROM benchmark",
    "prompt_chat": f"SELECT conv_id, turn, {_CHAT} AS message FROM conversations",
    "prompt_template": "SELECT item_id, " + ", ".join(f"{_FILL.format(h)} AS {n}" for n, h in (("query", "'Instruct: find' || chr(10) || 'Query: '"), ("bare", "'Query: '"), ("document", "''"))) + " FROM benchmark",
    "instruction_length": "SELECT item_id, CAST(CASE WHEN item_id % 2 = 0 THEN 4 + 575 ELSE 0 END AS BIGINT) AS n FROM benchmark",
    "md5_key": "SELECT page_id, md5(url || '|' || CAST(length(html) AS VARCHAR) || '|' || CAST(page_id AS VARCHAR)) AS key FROM pages",
    "uri_dispatch": "SELECT page_id, (['file', 'data', 'path', 'http'])[page_id % 4 + 1] AS kind, CASE page_id % 4 WHEN 1 THEN base64(encode(substring(url, 1, 30))) WHEN 2 THEN 'dir/' || url ELSE url END AS payload FROM pages",
    "smart_resize": _RESIZE,
    "l2_normalize": f"WITH {VECTORS}, a AS ({_sql_rows(f'list_transform(v, lambda x: x / greatest({_NORM}, 1e-12))', 'e')}), b AS ({_sql_rows(f'list_transform(v, lambda x: x / ({_NORM} + 1e-12))', 'e', x='y')}) SELECT vec_id, pos, x, y FROM a JOIN b USING (vec_id, pos)",
    "layer_norm": f"WITH {VECTORS}, u AS (SELECT *, list_sum(v) / 64 AS mu FROM e), w AS (SELECT *, list_sum(list_transform(v, lambda x: (x - mu) * (x - mu))) / 64 AS var FROM u) {_sql_rows('list_transform(v, lambda x: (x - mu) / sqrt(var + 1e-5))', 'w')}",
    "rms_norm": f"WITH {VECTORS} {_sql_rows('list_transform(v, lambda x, i: x / sqrt(list_dot_product(v, v) / 64 + 1e-6) * (CAST(i AS DOUBLE) / 64))', 'e')}",
    "mean_pool": f"WITH {VECTORS} SELECT label, CAST(i - 1 AS BIGINT) AS pos, round(sum(CASE WHEN vec_id % 4 = 0 THEN 0e0 ELSE v[i] END) / greatest(sum(CASE WHEN vec_id % 4 = 0 THEN 0e0 ELSE 1e0 END), 1e-9), 6) AS x FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i",
    "last_pool": f"WITH {VECTORS}, l AS (SELECT label, arg_max(v, vec_id) AS v FROM e WHERE vec_id % 4 <> 0 GROUP BY label) {_sql_rows('v', 'l', 'label')}",
    "first_pool": f"WITH {VECTORS}, l AS (SELECT label, arg_min(v, vec_id) AS v FROM e GROUP BY label) {_sql_rows('v', 'l', 'label')}",
    "fuse_mean": f"{_FUSED.format(VECTORS)}, g AS (SELECT vec_id, list_transform(v, lambda x, k: (x + v[65 - k]) / 2e0) AS v FROM f) {_sql_rows(f'list_transform(v, lambda x: x / greatest({_NORM}, 1e-12))', 'g')}",
    "fuse_weighted": f"{_FUSED.format(VECTORS)} {_sql_rows('list_transform(v, lambda x, k: x * 6e-1 + v[65 - k] * 4e-1)', 'f')}",
    "fuse_missing": f"{_FUSED.format(VECTORS)}, z AS (SELECT vec_id, p AS policy, list_transform(v, lambda x, k: CASE WHEN vec_id % 3 <> 0 THEN (x + v[65 - k]) / 2e0 WHEN p = 'text' THEN x WHEN p = 'zero' THEN x / 2e0 ELSE (x + 5e-1) / 2e0 END) AS z FROM f, (SELECT unnest(['text', 'zero', 'blank']) AS p)) SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(z[i], 6) + 0e0 AS x, policy FROM z, (SELECT unnest(range(1, 65)) AS i)",
    "rotate_half": f"WITH {VECTORS} {_sql_rows('list_concat(list_transform(v[33:64], lambda x: -x), v[1:32])', 'e')}",
    "pool_mask": "SELECT item_id, i AS pos, CAST(CASE WHEN i < item_id % 9 OR i < item_id % 5 THEN 0 ELSE 1 END AS BIGINT) AS x FROM benchmark, (SELECT unnest(range(0, 12)) AS i)",
    "position_ids": "SELECT item_id, i AS pos, CAST(CASE WHEN i < item_id % 5 THEN 1 ELSE i - item_id % 5 END AS BIGINT) AS x FROM benchmark, (SELECT unnest(range(0, 12)) AS i)",
    "cum_offsets": 'SELECT conv_id, turn, length(text) AS n, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM conversations',
}
