"""Language identification, toxicity and main text."""

import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankspark.llm import html_text, langid, toxicity
from rankspark.llm.queries import op7_toxicity, op8_langid, op10_html

EN = "the cat and the dog were walking through the long street when it rained on them with some thunder"
FR = "le chat et le chien marchaient dans la longue rue quand il pleuvait sur eux avec quelque tonnerre"
RU = "кошка и собака шли по длинной улице когда пошёл дождь"


def model():
    return langid.fit([(EN, "en"), (EN[10:], "en"), (FR, "fr"), (FR[8:], "fr"), (RU, "ru"), (None, "en"), ("", "fr")])


def test_spans_of_mixed_text():
    lang, score, spans = langid.label(model(), [f"{EN} {FR} {FR}"])[0]
    assert lang == "fr" and 0.5 < score < 0.8
    assert [s[2] for s in spans] == ["en", "fr"] and abs(spans[1][0] - len(EN.split())) <= 1


def test_scripts_narrow_the_languages():
    m = model()
    assert langid.label(m, ["улице дождь"])[0][0] == "ru"
    assert langid.label(m, ["日本語"])[0][:2] == (m.languages[0], 0.0)  # nothing is known of this script
    assert langid.script_of("é") == "latin" and langid.script_of("Ж") == "cyrillic" and langid.script_of("語") == "han"


def test_texts_without_letters():
    assert [x[0] for x in langid.label(model(), [None, "", "123 !?", "the", "² ⅷ", "x²"])][:5] == ["und", "und", "und", "en", "und"]
    assert langid.label(langid.fit([]), ["the"]) == [("und", 0.0, [])]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=6), st.integers(0, 10**6))
def test_viterbi(lengths, seed):
    rng = np.random.default_rng(seed)
    scores = [rng.integers(-9, 1, (n, 3)).astype(np.float32) for n in lengths]
    for s, path in zip(scores, langid.viterbi(scores, 4.0)):
        best = np.zeros(3)
        for t, row in enumerate(s):
            best = row + (np.maximum(best, best.max() - 4.0) if t else 0)
        if len(s):
            got = s[np.arange(len(s)), path].sum() - 4.0 * (np.diff(path) != 0).sum()
            assert got == pytest.approx(best.max())


def test_held_out_accuracy_of_language(spark):
    sf = "/root/testdata/sf0.01"
    found = op8_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count() > 0
    row = op8_langid(spark, sf).first()
    assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)


def test_words_are_read_to_their_last_letter(spark):
    """Words of any length; scores against a plain sum over all n-grams."""
    m = model()
    rng = np.random.default_rng(5)
    words = ["the", "q" * 40 + "the" * 60, "q" * 40 + "чат" * 60, *("".join(rng.choice(list("theransonqéж"), n)) for n in (39, 40, 41, 199, 200, 201, 260, 70_000))]
    table = m.score(words)
    for w, row in zip(words, table):
        found = [m.table[m.numbers.get(g, len(m.table) - 1)] for g in langid.grams(w)]
        s = np.sum(found, 0) / np.sqrt(len(found)) + (m.table[m.numbers[" " + w]] if " " + w in m.numbers else 0)
        may = m.scripts.get(langid.script_of(w[0]), np.zeros(len(m.languages), bool))
        want = np.where(may, np.maximum(s - s[may].max(), langid.RULED_OUT / 2), langid.RULED_OUT) if may.any() else 0 * s
        assert row == pytest.approx(want, abs=1e-3)
    assert table[1].tolist() != table[2].tolist()  # they differ beyond the 40th letter only
    for _ in range(3):  # long words are scored for one batch and leave the cache
        assert [x[0] for x in langid.label(m, [EN, words[-1], words[1], FR])][0::3] == ["en", "fr"]
    assert max(map(len, m.cache)) > langid.LONG and m.passing == 2
    langid.label(m, [RU])
    assert max(map(len, m.cache)) <= langid.LONG and sorted(m.cache.values()) == list(range(len(m.cache)))
    df = spark.createDataFrame([(1, "mot " * 150_000), (2, "x" * 500_000), (2, "x" * 500_000)], "doc_id long, text string")
    assert langid.identify(df, m, lasting=False).count() == 3


def test_language_columns(spark):
    df = spark.createDataFrame([(1, EN, "old", "x"), (2, None, None, "y")], "doc_id long, text string, lang_pred string, Score string")
    out = langid.identify(df, model())
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "lang_spans"]
    assert {r["doc_id"]: r["lang_pred"] for r in out.collect()} == {1: "en", 2: "und"}
    assert langid.identify(df.limit(0), model()).count() == 0
    assert langid.train(df.withColumnRenamed("lang_pred", "lang").limit(0)).languages == []


def test_a_rare_language_is_learned(spark, tmp_path):
    import corpus_pipeline

    assert langid.quota([5, 100, 100], 45) == 20 and langid.quota([5, 6], 45) == 6 and langid.quota([3, 3], 1) == 1 and langid.quota([], 9) == 1
    rows = [(i, f"{EN} {i}", "en") for i in range(3000)] + [(3000 + i, RU, "ru") for i in range(3)]
    df = spark.createDataFrame([*rows, (4001, "日本語", "ja"), (4002, "日本語", None)], "doc_id long, text string, lang string")
    model = langid.train(df.where("lang <> 'ja'"), most_rows=40)
    assert model.languages == ["en", "ru"] and langid.label(model, [RU])[0][0] == "ru"
    held = next(i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 4 == 2)  # its language is in no training fold
    docs = df.where("doc_id < 4000").union(spark.createDataFrame([(held, "日本語", "ja"), (4002, "日本語", None)], df.schema))
    stay = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert held in stay and 4002 not in stay and stay >= {3000, 3001, 3002}


def test_a_short_text_stays_if_its_script_was_learned(spark):
    import corpus_pipeline

    short = [(9000, "日本語", None), (9001, "日本語 日本", None), (9002, "EN\u00e9", None), (9003, "zqx", None), (9004, "привет", None), (9005, "日本語 ok", None), (9006, "12", None), (9007, None, None)]
    docs = spark.createDataFrame([*((i, f"{EN} {i}", "en") for i in range(40)), *((i, f"{RU} {i}", "ru") for i in range(40, 80)), *short], "doc_id long, text string, lang string")
    stay = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert stay == {*range(80), 9002, 9003, 9004, 9005}
    none = langid.Model([], {}, np.zeros((1, 0)), {})
    assert not re.search(langid.letters_of(none), "a")


KNOWN = set(toxicity.Grammar().rates)
GRAMMAR = toxicity.Grammar({"idiot": 1e-6, "scum": 1e-6, "clown$": 1e-5, "often": 1e-2}, -6.0, 4.0)


def weight(text):
    return GRAMMAR.evidence(text)[1]


def test_clauses():
    assert weight("you are an idiot") > weight("what an idiot") > weight("not an idiot") > 0
    assert weight("what an idiot") > weight("he wrote an idiot") - GRAMMAR.weights.target > 0
    assert weight("i will kill you idiots") > weight("you are an idiot")
    assert weight("kill the process") == weight("you will kill it") == 0 < weight("they killed, and will kill them") < 0.2
    assert weight("not one two three four idiot") == weight("what an idiot")


def test_threats_score_by_themselves():
    plain = toxicity.Grammar()
    score = lambda t: plain.score(t)[0]
    assert score("I will kill you tonight. I will hurt you.") > 0.7 > score("The frost will kill them.")
    assert score("Ich werde dich töten. Je vais te tuer.") > 0.7 and score("I will not kill you.") < 0.3 > score("They burn wood.")
    assert score("I will kill you") > score("He said I will kill you") > score("")
    assert score("You idiot, you moron") > 0.7 > score("nobody is an idiot")


PIECES_OF = {toxicity.OTHER: "x", toxicity.INSULT: "idiot", toxicity.VERB: "kill", toxicity.WILL: "will", toxicity.YOURS: "you", toxicity.OBJECT: "dich", toxicity.THEIRS: "them", toxicity.DENIAL: "not", toxicity.REPORT: "said"}


def plain_marks(classes):
    """Marks of a clause by their definitions, each word looking at the words before it."""
    reach, out, someone = toxicity.REACH, [], (toxicity.YOURS, toxicity.OBJECT, toxicity.THEIRS)
    struck = -1  # where the last threat or hint ended
    for i, k in enumerate(classes):
        denied = toxicity.DENIAL in classes[max(0, i - reach) : i + 1]
        context = 1 if denied else 2 if toxicity.REPORT in classes[: i + 1] else 0
        if k == toxicity.INSULT:
            out.append(("insult", context))
        both = lambda part: toxicity.INSULT in part and any(x in part for x in someone)
        if both(classes[: i + 1]) and not both(classes[:i]):
            out.append(("aim", context))
        willing = lambda j: toxicity.WILL in classes[max(0, j - reach) : j]
        near = range(max(struck + 1, i - reach + 1), i)
        verbs = [j for j in near if classes[j] == toxicity.VERB]
        # an object that an intention leads to, with no verb before it that it belongs to
        objects = [j for j in near if classes[j] == toxicity.OBJECT and willing(j)]
        if k == toxicity.VERB and objects:
            out.append(("threat", context))
            struck = i
        elif k in someone and verbs:
            out.append(("threat" if willing(verbs[-1]) and k != toxicity.THEIRS else "hint", context))
            struck = i
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=14))
def test_the_composed_machine_against_definitions(classes):
    table, state, got = toxicity.composed(), 0, []
    for k in classes:
        got += table.out[state][k]
        state = table.next[state][k]
    assert sorted(got) == sorted(plain_marks(classes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 8), max_size=9), max_size=5))
def test_evidence_against_definitions(clauses):
    text = ". ".join(" ".join(PIECES_OF[k] for k in c) for c in clauses)
    words, w = sum(map(len, clauses)), GRAMMAR.weights
    factor = (1.0, w.denied, w.reported)
    counts = {"idiot": 0.0, toxicity.THREAT: 0.0, toxicity.HINT: 0.0}
    for c in clauses:
        for kind, context in plain_marks(c):
            name = {"insult": "idiot", "aim": "idiot", "threat": toxicity.THREAT, "hint": toxicity.HINT}[kind]
            counts[name] += w.target if kind == "aim" else factor[context] * (w.hint if kind == "hint" else 1.0)
    rates = {"idiot": 1e-6, toxicity.THREAT: 1e-6, toxicity.HINT: 1e-4}
    want = 0.0
    for name, c in counts.items():
        n = min(c, toxicity.REPEATS) + max(c - toxicity.REPEATS, 0) * max(0, 1 - toxicity.PASSAGE / max(words, 1))
        if n > words * rates[name]:
            want += n * np.log(n / (words * rates[name])) - (n - words * rates[name])
    assert GRAMMAR.evidence(text)[0] == pytest.approx(want)


def test_weights_are_learned():
    """Where denied insults are as toxic as others, a denial is worth as much; where they are clean, next to nothing."""
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    text = lambda *more: " ".join([*rng.choice(words, 25), *more])
    base = [(text(), 0) for _ in range(300)] + [(text("zorka"), 1) for _ in range(80)]
    as_toxic, as_clean = (toxicity.fit(base + [(text("not", "zorka"), y) for _ in range(80)]) for y in (1, 0))
    assert as_toxic.weights.denied > as_clean.weights.denied
    t = text("not", "zorka")
    assert as_toxic.score(t)[0] > 0.7 > as_clean.score(t)[0]


def test_toxicity_edges(spark):
    long = "fine words " * 200_000 + "you idiot"
    df = spark.createDataFrame([(1, "you idiot, you moron", 0.5), (1, "you idiot, you moron", 0.5), (2, None, 0.5), (3, long, 0.5)], "doc_id long, text string, TOXICITY double")
    got = toxicity.score(df, toxicity.Grammar()).collect()
    assert [sorted(r.asDict()) for r in got] == [["doc_id", "text", "toxic_matches", "toxicity"]] * 4
    assert got[0]["toxicity"] == got[1]["toxicity"] > 0.7 > got[2]["toxicity"] and got[3]["toxic_matches"] == 2
    kept = toxicity.score(df, toxicity.Grammar(), out="Score", hits="N", lasting=False)
    assert kept.columns == ["doc_id", "text", "TOXICITY", "Score", "N"] and kept.count() == 4
    assert toxicity.score(df.limit(0), toxicity.Grammar()).count() == 0


def test_scores():
    low = GRAMMAR.score("")[0]
    assert low == GRAMMAR.score(None)[0] == GRAMMAR.score("a fine day. idio")[0] < 0.1
    assert GRAMMAR.score("Fine. IDIOTIC!")[0] > 0.7 and GRAMMAR.score("clowns")[0] == low and GRAMMAR.score("clown")[1] == 1


def test_chance_and_repetition_are_no_evidence():
    filler = " ".join(f"word{chr(97 + i % 26)}" for i in range(300))
    assert GRAMMAR.evidence(f"{filler} often often often")[0] == 0.0
    assert GRAMMAR.evidence("idiot " * 50)[0] == GRAMMAR.evidence("idiot idiot " + "x " * 48)[0]


def test_repeats_grow_with_a_text():
    filler = " ".join(f"word{chr(97 + i % 26)}" for i in range(600))
    found = [GRAMMAR.evidence(f"{filler} {'clown ' * n}")[0] for n in (2, 20, 80)]
    assert found[0] > 0 and found[1] > 8 * found[0] and found[2] > 3 * found[1]
    long = " ".join([filler] * 20)  # chance gives more than two matches in so many words
    rare = toxicity.Grammar({"grubl": 3e-4}, -6.0, 4.0)
    assert rare.evidence(f"{long} {'grubl ' * 2}")[0] == 0.0 and rare.score(f"{long} {'grubl ' * 400}")[0] > 0.7


def test_learned_stems():
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    clean = [(" ".join(rng.choice(words, 40)), 0) for _ in range(400)]
    toxic = [(" ".join([*rng.choice(words, 40), f"zorka{rng.choice(words)}"]), 1) for _ in range(60)]
    grammar = toxicity.fit(clean + toxic)
    assert set(grammar.rates) - KNOWN == {"zorkaw"}
    assert all((grammar.score(t)[0] >= 0.7) == bool(y) for t, y in clean + toxic)
    assert set(toxicity.fit([]).rates) == set(toxicity.fit(clean).rates) == KNOWN
    some = [(f"{t} zorkab" if i % 20 == 0 else t, 0) for i, (t, _) in enumerate(clean)]  # clean texts have a stem by chance
    twice = [(f"{t} zorkaq zorkaz", 1) for t, _ in toxic]
    grammar = toxicity.fit(some + twice)
    assert sum(grammar.score(t)[0] >= 0.7 for t, _ in twice) == 60 and sum(grammar.score(t)[0] >= 0.7 for t, _ in some) == 0


def test_a_small_language_has_its_stems():
    rng = np.random.default_rng(3)
    words = {x: [f"{x}{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)] for x in "wv"}
    text = lambda x, *more: " ".join([*rng.choice(words[x], 30), *more])
    clean = [(text("w"), 0) for _ in range(1200)] + [(text("v"), 0) for _ in range(400)]
    large, small = [(text("w", "zorka"), 1) for _ in range(400)], [(text("v", "grubl"), 1) for _ in range(14)]
    grammar = toxicity.fit(clean + large + small)
    assert set(grammar.rates) - KNOWN == {"grubl", "zorka"}
    assert all((grammar.score(t)[0] >= 0.7) == bool(y) for t, y in clean + large + small)


def test_toxicity_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" grubling" if i % 5 == 0 else "")) for i in range(500)] + [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = op7_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 502
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["doc_id"] % 5 == 0 and r["doc_id"] < 500) and 0 <= r["score"] <= 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>gone</p> --><div class="cookie-notice"><p>We use cookies, and more cookies, all day.</p></div>
<div id="wrap"><div class="sidebar"><p>Some side text, which is long enough to score, too.</p></div>
<article class="post"><h1>Head &amp; line</h1><p>First  paragraph with <b>bold
text</b> and a <a href="x">link</a>, and commas, to score.<p>Second one &eacute;&#233;&#xe9; 1 &lt; 2, unclosed
<ul><li>one<li>two</ul><div class="ad"><p>Buy this now, please, it is cheap.</p></div><form><p>Mail</p><input></form>
<blockquote>Quoted words.</blockquote><pre>a
 b</pre><table><tr><td>x<td>y</table><aside>aside</aside></article>
<section id="comments"><article class="comment"><p>A reader says something long, with commas, here.</p></article></section></div><footer>&copy; Site</footer></body></html>"""


def test_main_text():
    want = ["Head & line", "First paragraph with bold text and a link, and commas, to score.", "Second one ééé 1 < 2, unclosed", "one", "two", "Quoted words.", "a b", "x", "y"]
    assert html_text.main_text(PAGE).split("\n") == want


def test_pages_without_an_article_element():
    body = "".join(f"<p>Paragraph {i}, which has commas, and some length to it.</p>" for i in range(4))
    html = f"<body><div class='menu'><a href=a>one</a> <a href=b>two</a></div><div class=content><h2>Title</h2>{body}</div><div><a href=x>{'link ' * 30}</a></div></body>"
    assert html_text.main_text(html).split("\n") == ["Title", *[f"Paragraph {i}, which has commas, and some length to it." for i in range(4)]]


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<script>x", "<!-- open", "<nav>menu</nav>"])
def test_pages_without_text(html):
    assert html_text.main_text(html) == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<td>", "<table>", "</table>", "<article>", "</article>", "</html>", "<br>", "<", "&amp;", "text ", "<a href='>'>", "</a>", "<body>", "<script>", "</script>", "<!--"]), max_size=40))
def test_no_page_breaks_it(parts):
    html_text.main_text("".join(parts))


PARAGRAPHS = "<p>One long paragraph here, with commas, and enough text to count, as it goes on.</p>" * 3


@pytest.mark.parametrize("opening", ['<div class="layout with-sidebar">', '<article class="post comments-open">', '<div class="post no-footer">', '<section class="story share-enabled">', '<div id="main-content" class="menu-open">', '<form id="whole-page">', '<div class="sidebar-content-wrap">', "<article><header><h2>A title</h2><p>by somebody</p></header>"])
def test_containers_with_doubtful_names_keep_their_text(opening):
    tag = opening[1:].split(" ")[0].split(">")[0]
    around = "<div class='left-sidebar'><p>Side text, that is long enough, to count as well.</p></div><section id=comments><p>A reader, with commas, and so on.</p></section>"
    html = f"<body><nav><a href=x>menu</a></nav>{opening}{PARAGRAPHS}</{tag}>{around}<footer>f</footer></body>"
    want = ["A title"] * ("h2" in opening) + ["One long paragraph here, with commas, and enough text to count, as it goes on."] * 3
    assert html_text.main_text(html).split("\n") == want


@pytest.mark.parametrize("name,bad", [("with-sidebar", 0), ("sidebar", 2), ("sidebarLeft", 2), ("comment-list", 2), ("post-comments", 1), ("no-ads", 0), ("story", 0), ("ad-slot-7", 1), ("nav-open", 0), ("masthead__inner", 2)])
def test_names(name, bad):
    assert html_text._roles(f' class="{name}"')[1] == bad


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "</i>" * 60_000, '<a "x ' * 120_000, "<a x " * 150_000, '<a x="y ' * 90_001 + ">", "<b>" * 50_000 + "<div></div>" * 50_000, "<article>" + "<i>" * 70_000 + "</b>" * 70_000, "<!" * 300_000, "<table><td>" * 40_000, "<p>" * 150_000])
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 6  # minutes if it grew with the square


def plain_points(root):
    """Tree scores by their definition: each node asks all paragraphs of the page."""
    nodes = html_text._nodes(root)
    text = lambda x: sum(len(c) if isinstance(c, str) else text(c) for c in x.children)
    links = lambda x: sum(0 if isinstance(c, str) else text(c) if c.tag == "a" else links(c) for c in x.children)
    density = lambda x: min(links(x) / max(text(x), 1), 1)
    out = {}
    for x in nodes:
        points = html_text.TAG_POINTS.get(x.tag, 0.0) + 10.0 * (x.good and x.tag in html_text.TAG_POINTS) if text(x) else 0.0
        for p in nodes:
            own = html_text._own(p)
            if p.tag in html_text.PARAGRAPHS and len(own) >= html_text.LEAST_PARAGRAPH:
                worth = (1 + own.count(",") + min(len(own) / 100, 3)) * (1 - density(p))
                up = p if p.tag in ("div", "section", "article", "main", "body") else p.parent
                points += worth if up is x else worth / 2 if up is not None and up.parent is x else 0.0
        out[id(x)] = (points, points * (1 - density(x)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=story>", "</div>", "<section>", "</section>", "<li>", "<td>", "<table>", "<article>", "</article>", "<a href=x>", "</a>", "A few words, with commas, to count. ", "short "]), max_size=30))
def test_tree_scores_against_their_definition(parts):
    root = html_text.parse("".join(parts))
    html_text._prune(root)
    for x in html_text._nodes(root):
        x.points = 0.0
    want = plain_points(root)
    nodes = html_text._nodes(root)
    html_text._score(nodes)
    for x in nodes:
        assert (x.points, html_text._value(x)) == pytest.approx(want[id(x)])


def test_pages_whose_article_element_is_known(spark):
    """Every page of the smallest tables: what its article element holds, and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.extract(pages, out="main").collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)
        if inside:
            assert " ".join(r["main"].split()) == " ".join(unescape(re.sub(r"<[^>]+>", " ", inside[1])).split())


def test_html_edges(spark):
    rows = [(1, PAGE, "x"), (1, PAGE, "x"), (2, f"<div>{PARAGRAPHS}</div><div>{PARAGRAPHS}</div>", "y"), (3, "<p>" + "word, " * 200_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, `TEXT` string")
    got = html_text.extract(df).collect()
    assert len(got) == 4 and got[0]["text"] == got[1]["text"] and got[3]["text"] == ("word, " * 200_000).strip()
    assert got[2]["text"].count("One long") == 6  # equal containers side by side
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_query(spark, tmp_path):
    rows = [(1, "u", PAGE), (2, "v", None), (3, None, "<p>x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in op10_html(spark, str(tmp_path)).collect()}
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"]) == ("", 0, "x")
    assert got[1]["n_chars"] == len(got[1]["text"])
    clash = spark.createDataFrame([(1, PAGE, "own")], "page_id long, html string, text string")
    assert html_text.extract(clash).first()["text"].startswith("Head")
