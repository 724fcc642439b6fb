"""The training-data operators against brute force, exact round trips and held-out accuracy, with the defined edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trailnote.llm import bpe, chat, htmltext, media, minhash, mixing, passages, quality, queries, toxicity, warc
from trailnote.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, junk, edge cases and one long text."""
    rng = random.Random(5)
    out = {0: None, 1: "", 2: " \t\n\x0b\x0c\r ", 3: "one two", 4: "One TWO", 5: "a b c d", 6: "x " * 400, 7: "é ü z \U0001f600 <|endoftext|>"}
    base = words(rng, 200)
    out[10] = " ".join(base)
    out[11] = out[10].upper().replace("W", "w")
    for i in range(12, 20):
        near = list(base)
        for _ in range(i - 11):
            near[rng.randrange(len(near))] = f"e{i}{rng.randrange(9)}"
        out[i] = "\n".join(near)
    shared = words(rng, 60)
    for i in range(30, 40):
        out[i] = " ".join(words(rng, 80) + shared + words(rng, 40))
    short = words(rng, 49)
    for i in range(40, 43):
        out[i] = " ".join(words(rng, 60) + short + words(rng, 60))
    for i in range(50, 56):
        out[i] = " ".join(words(rng, 120))
    out[60] = " ".join(words(rng, 30_000))
    out[61] = out[60]
    out[62] = "line one here\nline one here\n\nother\nline one here"
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, v, "en", "hot" if k % 3 else None, len(v or "")) for k, v in texts.items()]
    return spark.createDataFrame(rows + rows[8:10], DOCS).repartition(5)


@pytest.fixture(scope="module")
def crowded(docs):
    """The same with columns whose names clash with the operators' own, and a row without an identifier."""
    clash = [F.lit(i).alias(c) for i, c in enumerate(("id", "n", "sig", "key", "row", "band", "cut", "copy", "rate", "component", "a.b", "numbers", "spans"))]
    return docs.select("*", *clash).unionByName(docs.filter("doc_id = 50").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars", *clash))


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(texts, percent):
    sets = {k: shingles(v) for k, v in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(texts, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in texts}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_against_all_pairs(spark, texts, crowded, percent):
    rows = minhash.near_duplicates(crowded, percent).collect()
    expected, sizes = components(texts, percent)
    assert len(rows) == len(texts) + 3
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept and r.n_links == 0
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (expected[r.doc_id], sizes[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_minhash_large_bucket_of_variants(spark):
    """More variants of one text than are paired directly, most linked only through others."""
    rng = random.Random(11)
    base = words(rng, 300)
    texts = {}
    for i in range(120):
        near = list(base)
        for _ in range(1 + i % 8):
            near[rng.randrange(300)] = f"q{i}x{rng.randrange(1000)}"
        texts[i] = " ".join(near)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 85).collect()}
    assert got == components(texts, 85)[0]


@pytest.mark.parametrize("paired", [1, 10**9])
def test_minhash_pairs_small_and_large_buckets_alike(spark, texts, crowded, monkeypatch, paired):
    """Every bucket by its center, or every bucket by all its pairs."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    expected, _ = components(texts, 85)
    assert all(r.component_id == expected[r.doc_id] for r in minhash.near_duplicates(crowded, 85).collect() if r.doc_id is not None)


def variants(count, edits=8, size=300):
    """Variants of one text whose edits are three words at any of its places, so that many share an edit and most are linked only through others."""
    rng = random.Random(13)
    base = words(rng, size)
    for i in range(count):
        near = list(base)
        for at in rng.sample(range(size), edits):
            near[at] = rng.choice(("left", "right", "middle"))
        yield i, " ".join(near)


def test_minhash_variants_that_share_edits_meet_in_few_pairs(spark, monkeypatch):
    asked = []
    verified = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    counts = {}
    for count in (400, 1600):
        texts = dict(variants(count))
        asked.clear()
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 85).collect()}
        counts[count] = sum(asked)
        if count == 400:
            assert got == components(texts, 85)[0]
    # Four times the variants: sixteen times as many pairs in all, a multiple of four of those that are asked.
    assert counts[1600] <= 6 * counts[400], counts


def test_minhash_texts_from_a_template_meet_in_few_pairs(spark, monkeypatch):
    """Texts of 150 words, equal but for four slots of four words each and two words of their own: few are linked, and most are near each other."""
    asked, verified, counts = [], minhash._verified, {}
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    for count in (300, 1200):
        rng, base, texts = random.Random(53), [f"b{i}" for i in range(150)], {}
        for k in range(count):
            own = list(base)
            for slot in (20, 50, 80, 110):
                own[slot] = f"slot{slot}x{rng.randrange(4)}"
            own[135], own[144] = f"own{k}a", f"own{k}b"
            texts[k] = " ".join(own)
        asked.clear()
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 85).collect()}
        counts[count] = sum(asked)
        if count == 300:
            assert got == components(texts, 85)[0]
            assert 20 < len(set(got.values())) < 300
        else:
            # The same combination of slots is one component, at the most.
            assert len(set(got.values())) >= 200
    assert counts[1200] <= 6 * counts[300], counts


def test_deduplicated_keeps_columns_and_one_of_each(crowded, texts):
    kept = minhash.deduplicated(crowded, 80)
    assert kept.columns == crowded.columns
    expected, _ = components(texts, 80)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted(k for k, c in expected.items() if k == c)


def test_deduplicated_rows_of_one_doc_id_that_differ(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(1, base, "a"), (1, base, "b"), (1, base, "a"), (2, base, "a"), (3, "some other words that stand here", "a"), (None, base, "a"), (None, base, "a")]
    kept = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id or 0, r.source) for r in kept) == [(0, "a"), (0, "a"), (1, "a"), (1, "b"), (3, "a")]


def test_bayesian_bounds():
    least = minhash.least_matches(0.85)
    assert least == sorted(least) and least[0] <= 6 and least[-1] < 0.85 * minhash.PERMUTATIONS


def repeated_words(texts, least=50):
    """Per document the words that lie in a run of least words which an earlier document has too."""
    split = {k: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(v or "")] for k, v in texts.items()}
    seen, out = {}, {}
    for k in sorted(split):
        w = split[k]
        runs = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        out[k] = {i + j for i, r in enumerate(runs) if r in seen for j in range(least)}
        for r in runs:
            seen.setdefault(r, k)
    return out


def test_passages_cover_every_exact_repeat(crowded, texts):
    rows = passages.repeated_passages(crowded).collect()
    covered = {}
    for r in rows:
        assert r.source_doc_id < r.doc_id and r.end_word - r.start_word >= passages.MIN_WORDS and r.similarity >= passages.SIMILARITY
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for k, expected in repeated_words(texts).items():
        assert expected <= covered.get(k, set()), k
    clean = {0, 1, 2, 3, 5, 6, 10, 30, 60, 62, *range(40, 43), *range(50, 56)}
    assert not clean & covered.keys()


def test_near_passages(spark):
    """Passages of 100 words with two words changed: similarity about 0.81."""
    rng = random.Random(3)
    pairs, rows = 60, []
    for i in range(pairs):
        p = words(rng, 100)
        q = list(p)
        q[30], q[70] = "changed", "too"
        rows += [(2 * i, " ".join(words(rng, 50) + p + words(rng, 50))), (2 * i + 1, " ".join(words(rng, 30) + q + words(rng, 70)))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).filter("end_word - start_word >= 90").select("doc_id").distinct().count()
    assert found >= 0.9 * pairs


def test_without_repeats_leaves_first_and_clean_texts(crowded, texts):
    out = passages.without_repeats(crowded)
    assert out.columns == crowded.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[30] == texts[30] and got[60] == texts[60] and 61 not in got and got[0] is None and got[62] == texts[62]
    for i in range(31, 40):
        left = WORD.findall(got[i])
        assert left[:78] == WORD.findall(texts[i])[:78] and 115 <= len(left) <= 120


def test_bpe_equals_tiktoken_and_round_trips(crowded, texts):
    import public_tokenizers

    path = public_tokenizers.path(queries.RANKS)
    tokenizer = bpe.encoding(path, public_tokenizers.PATTERN)
    rows = bpe.digests(crowded, path, public_tokenizers.PATTERN).filter("doc_id IS NOT NULL").collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = tokenizer.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    tables = bpe.decoded(bpe.encoded(crowded, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert all(bytes(r.bytes) == (texts.get(r.doc_id, texts[50]) or "").encode() for r in tables.collect())


def test_bpe_pieces_do_not_change_ids(texts):
    import public_tokenizers

    tokenizer = bpe.encoding(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(1)
    odd = "".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "12", "é", "中", "!", "　", "\t"]) for _ in range(4000))
    for text in (odd, texts[60], "x" * 5000, " " * 5000):
        assert list(bpe.encode(text, tokenizer, size=50)) == tokenizer.encode_ordinary(text)


def test_quality_counts_against_plain_python(crowded, texts):
    for r in quality.scored(crowded).filter("doc_id IS NOT NULL").collect():
        text = texts[r.doc_id] or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        where = {}
        for i in range(len(w) - 4):
            where.setdefault(tuple(w[i : i + 5]), []).append(i)
        repeated = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(repeated)), r.doc_id
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_poisson_counts_are_an_inverted_distribution(spark):
    from math import exp

    rows = [(i, f"t{i}", "big" if i % 4 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.drawn(docs, {"big": 1.0, "small": 1.0}, budget=2.0).groupBy("doc_id", "source", "rate").count().collect()
    rate = {r.source: r.rate for r in got}
    assert rate == {"big": pytest.approx(4000 / 3000), "small": pytest.approx(4.0)}
    counts = {r.doc_id: r["count"] for r in got}
    for i, _, source in rows[:300]:
        u = int(hashlib.md5(f"{mixing.SEED}:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, exp(-rate[source])
        below = term
        while below <= u:
            k += 1
            term *= rate[source] / k
            below += term
        assert counts.get(i, 0) == k
    assert abs(sum(counts.values()) - 8000) < 400


def test_mixing_edge_cases(spark, crowded):
    out = mixing.mixed_sources(crowded)
    assert out.columns == crowded.columns and {r.source for r in out.select("source").distinct().collect()} == {None, "hot"}
    assert mixing.mixed_sources(crowded, weights={"other": 1.0}).count() == 0
    heavy = mixing.drawn(spark.createDataFrame([(i, "x", "a") for i in range(20)], "doc_id long, text string, source string"), budget=100.0)
    assert 1700 < heavy.count() < 2300


def test_toxicity_held_out(spark):
    """Fitted on half of the labels, held against the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chain = toxicity.fitted(docs, labels.filter("hash(doc_id) % 2 = 0"))
    met = toxicity.scored(docs, chain).join(labels.filter("hash(doc_id) % 2 <> 0").select("doc_id", "toxic"), "doc_id")
    c = {(r.rejected, r.toxic): r["count"] for r in met.groupBy("rejected", "toxic").count().collect()}
    hit, false, missed = (c.get(k, 0) for k in ((True, 1), (True, 0), (False, 1)))
    assert hit / max(hit + false, 1) >= 0.85 and hit / max(hit + missed, 1) >= 0.6, c


def test_toxicity_edge_cases(spark, crowded):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.without_toxic(crowded, labels)
    assert out.columns == crowded.columns and out.count() == crowded.count()
    odd = spark.createDataFrame([(50, 1, 0), (50, 0, 1), (51, None, 0), (None, 1, 1), (52, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(crowded, toxicity.fitted(crowded, odd)).collect()
    assert len(rows) == crowded.count() and not any(r.rejected for r in rows if r.doc_id in (0, 1))


def test_toxicity_sample_is_bounded_and_every_text_scored(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    marks = labels.select("doc_id", "toxic", F.lit(0).alias("low_quality"))
    totals = dict(marks.groupBy("toxic").count().collect())
    for rows, most in ((5, 10**9), (5000, 3000), (5000, 0)):
        got = toxicity.sampled(docs, marks, totals, rows, most).collect()
        for toxic in totals:
            own = [r for r in got if r.toxic == toxic]
            assert len(own) <= rows and sum(len(r.numbers) // 4 for r in own) <= most
        assert bool(got) == (most > 0)
    chain = toxicity.fitted(docs, labels, most_features=0)
    assert {r.rejected for r in toxicity.scored(docs, chain).collect()} == {False}


def test_html_main_text(spark):
    page = lambda body: f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>menu</nav><div class='ad'>buy</div>{body}<footer>f</footer><script>if (a<b) x='</p>'</script></body></html>"
    rows = [
        (1, "http://a.example/x/1", page("<article><h1>A &amp; B</h1><p>one\n two<br>three <b>bo</b>ld<aside>no</aside></p><!-- c --><section class='comments'>reader</section></article>")),
        (2, "http://a.example/x/2", page("<div><p>shared line</p><p>own two</p></div>")),
        (3, "http://a.example/x/3", page("<div><p>shared line</p><p>own three &lt;ok&gt;</p><form>f</form></div>")),
        (4, "http://b.example/", page("<p>alone")),
        (5, None, None),
        (6, "", ""),
        (6, "", ""),
        (7, "not a url", "<p>broken <div class=\"sidebar\">s</div> &#x41;&eacute;"),
    ]
    got = {r.page_id: r for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B one two three bold"
    assert got[2].n_shared_lines and got[3].n_shared_lines and not got[4].n_shared_lines
    assert (got[2].text, got[3].text) == ("own two", "own three <ok>")
    assert (got[4].text, got[5].text, got[6].text, got[7].text) == ("alone", "", "", "broken Aé")
    assert all(r.n_chars == len(r.text) for r in got.values())


def longest(a, b):
    best = [[0] * (len(b) + 1)]
    for x in a:
        best.append([0])
        for j, y in enumerate(b):
            best[-1].append(best[-2][j] + 1 if x == y else max(best[-2][j + 1], best[-1][j]))
    return best[-1][-1]


@pytest.mark.parametrize("held, width", [(1 << 28, 4096), (8, 4096), (8, 3)])
def test_longest_common_subsequence(monkeypatch, held, width):
    monkeypatch.setattr(htmltext, "HELD", held)
    monkeypatch.setattr(htmltext, "WIDTH", width)
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(14))] for letters in ("abc", "abcd"))
        found = sorted(htmltext.common(a, b))
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[i] in rest for i in found)


def test_html_neighbours_and_lines_against_brute_force(spark, data):
    """On the page table: a neighbour shares as many folders as any page with other lines, and exactly a longest common subsequence goes."""
    rows = {r.page_id: r for r in table(spark, data, "pages").collect()}
    rows |= {-k: type(r)(page_id=-k, url=r.url.replace("://", "://x."), html=r.html.replace("<article", "<div").replace("</article", "</div")) for k, r in rows.items()}
    own = {k: htmltext.lines(r.html or "") for k, r in rows.items()}
    place = {k: (u := re.match(r"[^:]+://([^/?#]*)([^?#]*)", r.url))[1].lower() and (u[1].lower(), u[2].rsplit("/", 1)[0].split("/")) for k, r in rows.items()}
    depth = lambda a, b: next((i for i, (x, y) in enumerate(zip(place[a][1], place[b][1])) if x != y), min(len(place[a][1]), len(place[b][1]))) if place[a][0] == place[b][0] else -1
    kind = {k: any(m and not d for _, m, d, _ in x) for k, x in own.items()}
    facts = {k: htmltext.told(r.html) for k, r in rows.items()}
    assert {k: v[0] for k, v in facts.items()} == kind
    seen = spark.createDataFrame([(k, place[k][0], (re.match(r"[^:]+://[^/?#]*([^?#]*)", r.url))[1], kind[k], facts[k][1], k) for k, r in rows.items()], "rid long, host string, path string, declares boolean, digest long, seq long")
    near = {}
    for r in htmltext.neighbours(seen).collect():
        near.setdefault(r.rid, []).append(r.near)
    assert max(map(len, near.values())) == htmltext.NEAREST
    for k in rows:
        others = [depth(k, j) for j in rows if kind[j] == kind[k] and [x[0] for x in own[j]] != [x[0] for x in own[k]]]
        assert (k in near) == (max(others, default=0) >= 1) and (k not in near or max(depth(k, j) for j in near[k]) == max(others, default=0))
        assert all(kind[j] == kind[k] and depth(k, j) >= 1 and facts[j][1] != facts[k][1] for j in near.get(k, ()))
    pages = spark.createDataFrame(list(rows.values()), "page_id long, url string, html string")
    gone = 0
    for r in htmltext.extracted(pages).collect():
        assert r.n_chars == len(r.text)
        gone += r.n_shared_lines
        mine = [x[0] for x in own[r.page_id] if not htmltext.guarded(x)]
        most = [longest(mine, [x[0] for x in own[j] if not htmltext.guarded(x)]) for j in near.get(r.page_id, ())]
        text, shared = htmltext.main_text(rows[r.page_id].html or "", [facts[j][2].tolist() for j in near.get(r.page_id, ())])
        assert max(most, default=0) <= shared <= sum(most)
        # Ties between copies of a neighbour are open: any of them has the same lines.
        assert (r.text, r.n_shared_lines) == (text, shared)
    assert gone > 0


def test_html_differencing_settles_pages_without_structure(spark):
    """Pages of one site without article, class or known tag: what their neighbours repeat goes, menus entry by entry, and their own lines stay."""
    menu = lambda *names: "<div>" + " ".join(f"<a href='/{n}'>{n}</a>" for n in names) + "</div>"
    rows, want = [], {}
    for k in range(12):
        own = [f"title of page {k}", f"first paragraph of page {k} with <a href='/x'>two</a> <a href='/y'>links</a>", f"second one, {k}"]
        entries = [n for i, n in enumerate(["home", "news", "sports", "about"]) if i != k % 4]
        rows.append((k, f"http://s.example/a/{k}", f"<body>{menu(*entries)}<div>Welcome to the site</div>" + "".join(f"<div>{x}</div>" for x in own) + f"<div>Copyright</div>{menu('terms', 'imprint')}</body>"))
        want[k] = " ".join(re.sub("<[^>]*>", "", x) for x in own)
    got = {r.page_id: r.text for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_links_are_cut_at_white_space_only():
    found = lambda x: [t for t, *_ in htmltext.lines(x)]
    assert found("<div><a>one two</a> <a>three</a> | <a>four</a></div>") == ["one two", "three", "|", "four"]
    assert found("<div><a>on</a><a>e</a> <a>two</a></div>") == ["one", "two"]
    assert found("<div>see <a>one</a> <a>two</a></div>") == ["see one two"] and found("<div><a> </a> <a></a></div>") == []
    assert found("<div><a>x <b>y</b> z</a> <a>w</a></div>") == ["x y z", "w"]


def test_html_alignment_memory_is_bounded():
    """Two pages of 2 MB with 60,000 lines, of which every third differs: well under 100 MB."""
    import tracemalloc

    page = lambda k: "".join(f"<p>line {i if i % 3 else (i, k)} of some page</p>" for i in range(60_000))
    other, mine = htmltext.told(page(1))[2].tolist(), page(2)
    found = htmltext._hashes(htmltext.lines(mine)).tolist()
    tracemalloc.start()
    shared = htmltext.common(found, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(shared) == 40_000 and peak < 60 << 20


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a ">" ' * 150_000, "<div>" * 150_000 + "</x>" * 150_000, "<p><div>" + "<b>" * 150_000 + "<hr>" * 150_000, "<" * 10**6, "<p>x</p>" * 120_000, "<script>" * 120_000])
def test_html_scanner_is_linear(page):
    import time

    began = time.process_time()
    htmltext.lines(page)
    assert time.process_time() - began < 8


def test_html_broken_markup():
    text = lambda x: htmltext.main_text(x, None)[0]
    assert text('<p>a <b title="x>y">b</b> c') == "a b c"
    assert text('one <i>two <a href="never closed>three</a> four') == "one two three four"
    assert text("1 < 2 <p>3 > 2 <!-- > --> 4 <unclosed") == "1 < 2 3 > 2 4"
    assert text("wo<span class='ad'>no</span>rd</b></p> <textarea><p>no</textarea> end") == "word end"
    assert text("<article>in</article>out") == "in" and text("") == ""


def test_warc_chunks_give_payloads_back(spark):
    big = "x" * 200_000
    rows = [(1, "u", "a" * 1000), (2, "u\r\nX: y", "a" * 1000), (3, None, "a" * 999), (4, "u", "a" * 999), (5, "u", None), (6, "u", "é" + big), (7, "u", "é" + big), (None, "u", big), (8, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest, folder = warc.archived(pages)
    chunks = warc.read_chunks(manifest, folder).collect()
    assert max(len(c.data) for c in chunks) <= warc.CHUNK
    payload = {}
    for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk_no)):
        payload[c.record_id] = payload.get(c.record_id, b"") + bytes(c.data)
    last = {c.page_id: c for c in chunks if c.is_last}
    text = {k: (t or "").encode() for k, _, t in rows}
    refers = {1: 2, 6: 7}
    for k, c in last.items():
        assert c.bytes_so_far == len(text[k]) and c.digest_so_far == hashlib.sha1(text[k]).hexdigest()
        assert c.refers_to == refers.get(k) and c.record_type == ("revisit" if k in refers else "response")
        assert payload[c.record_id] == (b"" if k in refers else text[k])


def test_warc_payloads_come_in_chunks(spark):
    """No row on the way to the archives holds over CHUNK bytes; copies that share a join key do not mix, and a lost chunk is told."""
    big = "".join(chr(97 + i % 26) * 50 for i in range(40_000))
    rows = [(k, "u", big[: 1_900_000 + (k > 5)]) for k in range(8)] + [(8, "u", big[: warc.CHUNK]), (9, "u", big[: warc.CHUNK + 1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = warc.labelled(pages)
        sizes = {(r.page_id, r.chunk_no): r.n for r in chunks.select("page_id", "chunk_no", F.length("data").alias("n")).collect()}
        assert max(n or 0 for n in sizes.values()) == warc.CHUNK and sizes[9, 1] == 1 and (8, 1) not in sizes
        assert sum(n or 0 for n in sizes.values()) == 1_900_000 + 1_900_001 + 2 * warc.CHUNK + 1
        got = {r.page_id: r for r in warc.digests(pages).collect()}
        assert all(got[k].payload_digest == hashlib.sha1(t.encode()).hexdigest() and got[k].payload_bytes == len(t) for k, _, t in rows)
        assert {k: r.refers_to for k, r in got.items() if r.refers_to is not None} == {**dict.fromkeys(range(5), 5), 6: 7}
        with pytest.raises(Exception, match="missing|changed on its way"):
            warc.write_archives(chunks.filter("chunk_no <> 3"), warc.archived(pages)[1]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_warc_digests_with_clashing_columns(spark, data):
    pages = table(spark, data, "pages")
    clash = pages.select("*", *[F.lit(1).alias(c) for c in ("payload", "payload_digest", "record_id", "data", "at", "size", "run", "first_id")])
    a, b = (sorted(map(tuple, warc.digests(x).collect())) for x in (pages, clash))
    assert a == b and len(a) == pages.count()


def test_warc_detects_damage(spark, tmp_path):
    import pyarrow.fs

    manifest, folder = warc.archived(spark.createDataFrame([(1, "u", "payload " * 300)], "page_id long, url string, html string"))
    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    name = manifest.first().archive
    with store.open_input_file(f"{base}/{name}") as f:
        data = f.read()
    with store.open_output_stream(f"{base}/{name}") as f:
        f.write(data.replace(b"payload payload", b"payload paylaad", 1))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_chunks(manifest, folder).collect()


def test_chat_round_trip(spark):
    odd = ["", None, r"\### Assistant: </turn> ok", "\\", "\\\\h#<</turn>\n### user: x", "a\\h\\l", "é😀"]
    rows = [(i, t, r, odd[(i + t) % len(odd)]) for i in range(8) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(20, 0, "assistant", "x"), (21, 0, "user", "q"), (22, None, None, "n"), (23, 0, "us:er #<\\", "x"), (21, 0, "user", "q")]
    made = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)))
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for k in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == k), key=lambda v: (v[0] is not None, v))
        assert [(t.role, t.text) for t in got[k].turns] == [(r, x) for _, r, x in own]
        assert got[k].loss_text == "".join(x for _, r, x in own if r == "assistant")
    assert got[0].valid and not got[20].valid and not got[21].valid and not got[22].valid
    spoken = made.filter("conv_id = 2").first()
    assert spoken.formatted == "".join(s.text for s in spoken.segments) and spoken.formatted.count("</turn>") == 5


def test_chat_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "é\\#<" * 50 + str(t)) for t in range(4000)]
    got = chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))).first()
    assert [(t.role, t.text) for t in got.turns] == [(r, x) for _, _, r, x in rows] and got.valid
    assert got.loss_text == "".join(x for _, _, r, x in rows if r == "assistant")


def test_media_digests_and_fingerprints(crowded, texts):
    rows = media.features(media.stored(crowded)).filter("doc_id IS NOT NULL").collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
        assert list(r.fingerprint) == sorted(r.fingerprint)
    by = {r.doc_id: r for r in rows}
    assert by[0].feature == by[1].feature and by[60].feature == by[61].feature != by[10].feature


def test_fingerprint_against_a_plain_transform():
    import cmath
    import math

    import numpy as np

    rng = random.Random(31)
    samples = [rng.randrange(256) for _ in range(1500)]
    bins = media.peaks(np.array(samples, np.uint8))
    for t in range(len(bins)):
        part = [x - 128 for x in samples[t * media.HOP : t * media.HOP + media.FRAME]]
        part += [0] * (media.FRAME - len(part))
        mean = sum(part) / media.FRAME
        part = [(x - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1))) for i, x in enumerate(part)]
        power = [abs(sum(x * cmath.exp(-2j * math.pi * k * i / media.FRAME) for i, x in enumerate(part))) for k in range(1, media.FRAME // 2 + 1)]
        for band in range(media.BANDS):
            own = power[band * 32 : band * 32 + 32]
            found = bins[t, band]
            assert (found > 0) == (max(own) > sum(power) / len(power)) and (not found or own[found - 1 - band * 32] >= max(own) - 0.05)
    pairs = sorted(t << 32 | int(a) << 20 | int(b) << 8 | ahead for t in range(len(bins)) for ahead in (1, 2) if t + ahead < len(bins) for a, b in zip(bins[t], bins[t + ahead]) if a and b)
    assert media.fingerprint(np.array(samples, np.uint8)).tolist() == pairs and len(pairs) > 10
    long = np.array([rng.randrange(256) for _ in range(media.BLOCK * media.HOP * 2 + 77)], np.uint8)
    at = media.BLOCK - 3
    assert (media.peaks(long)[at : at + 6] == media.peaks(long[at * media.HOP : at * media.HOP + 5 * media.HOP + media.FRAME])).all()


def test_peaks_find_a_tone():
    import numpy as np

    t = np.arange(4096)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.FRAME)).astype(np.uint8)
    assert (media.peaks(tone)[:, 1] == 40).all()


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_queries_on_empty_tables(spark, data, tmp_path, name):
    for t in ("documents", "pages", "conversations", "labels", "embeddings"):
        table(spark, data, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = queries.queries()[name](spark, str(tmp_path)).collect()
    assert len(rows) == (1 if name.startswith("op8") else 0)
