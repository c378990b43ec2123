"""Segmentations, quotes, quality rules, URL verdicts, archives and the pipeline."""

import base64
import hashlib
import json
import math
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataframe.llm import chat, pieces, rules, urls, warc
from strataframe.llm.common import shared_path

PIECES = P.path("piece_bpe_32k.model")
LATTICES = pieces.Lattices(PIECES)
VOCAB = (PIECES, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
ODD = [(1, None, 5), (None, "", 5), (2, "a▁b  c \n\t漢字😀", 5), (2, "x " * 20000, 5), (3, "...", 5), (3, "...", 5)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(max_size=3))
def test_lossless(text, key):
    ids = LATTICES.sample([text], [key])[0]
    assert LATTICES.decode(ids) == text
    other = LATTICES.sample(["abc", text, "the of"], ["1", key, "2"])[1]
    assert ids.tolist() == other.tolist()


@pytest.mark.parametrize("word", ["the", "hello,", "ing"])
def test_samples_follow_the_lattice(word):
    spelt = {LATTICES.spelt[i].decode(): (int(i), math.exp(w)) for i, w in zip(LATTICES.ids, LATTICES.logw)}

    def ways(s):
        if not s:
            return {(): 1.0}
        out = Counter()
        for k in range(1, len(s) + 1):
            if s[-k:] in spelt:
                i, w = spelt[s[-k:]]
                for q, v in ways(s[:-k]).items():
                    out[(*q, i)] += v * w
        return out

    want = ways(f" {word}")
    total = sum(want.values())
    got = Counter(tuple(x.tolist()) for x in LATTICES.sample([word] * 20000, list(map(str, range(20000)))))
    assert all(abs(got[k] / 20000 - v / total) < 0.02 for k, v in want.items()) and set(got) <= set(want)


def test_pieces_of_several_spaces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["def f():\n   return 1", "  a  b" + " " * 40 + "c   ", " ", "   ", "if x:\n        y = 2\n\n\n    z\t  1", "|  a   |    2 |"]
    assert [LATTICES.decode(np.array(sp.encode(t), np.int64)) for t in texts] == texts
    several = {i for i in range(sp.vocab_size()) if "▁▁" in sp.id_to_piece(i)}
    assert len(several) == 14 and several <= set(LATTICES.ids.tolist())
    drawn = LATTICES.sample(texts * 200, list(map(str, range(200 * len(texts)))))
    assert [LATTICES.decode(x) for x in drawn] == texts * 200
    assert len(several.intersection(*[np.concatenate(drawn).tolist()])) >= 10


@pytest.mark.parametrize("text", ["  a", "a   b", "a    "])
def test_samples_follow_the_lattice_of_spaces(text):
    spelt = {LATTICES.spelt[i].decode(): (int(i), math.exp(w)) for i, w in zip(LATTICES.ids, LATTICES.logw)}
    want, whole = Counter({((), 0): 1.0}), " " + text
    for at in range(len(whole)):
        for (ids, end), v in list(want.items()):
            if end == at:
                for k in range(at + 1, len(whole) + 1):
                    if whole[at:k] in spelt:
                        i, w = spelt[whole[at:k]]
                        want[(*ids, i), k] += v * w
    want = {ids: v for (ids, end), v in want.items() if end == len(whole)}
    got = Counter(tuple(x.tolist()) for x in LATTICES.sample([text] * 20000, list(map(str, range(20000)))))
    assert all(abs(got[k] / 20000 - v / sum(want.values())) < 0.02 for k, v in want.items()) and set(got) <= set(want)


def test_pieces_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, ids int, key int")
    rows = pieces.decode(pieces.encode(df, PIECES), PIECES).collect()
    assert len(rows) == len(ODD) and all(r.decoded == r.text for r in rows)
    assert [r.ids for r in rows if r.text is None] == [None] and [r.ids for r in rows if r.text == ""] == [[]]
    same = [r.ids for r in rows if r.text == "..."]
    assert same[0] == same[1]
    assert pieces.encode(df.limit(0), PIECES).count() == 0


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def measures(text):
    v = rules.vocabularies(*VOCAB)
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for x in w for i in v.sp.encode(x)]
    n = max(1, len(ids))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    other = sum(len(v.bpe.encode_ordinary(f" {x}")) for x in w)
    return sum(map(len, w)) / n, sum(map(len, w)) / max(1, other), sum(v.sp.is_byte(i) for i in ids) / n, entropy / math.log2(min(max(len(ids), 2), v.size))


def groups(docs):
    """The bands by brute force: quantiles by linear interpolation over the distinct texts of a group that pass the base rule."""
    by = {}
    for text, lang in {(r.text, r.lang) for r in docs if r.text is not None}:
        if not base(text)[-1]:
            script = rules.NAMES[rules.majority_script(text)]
            for g in {(script, lang), (script, None)}:
                by.setdefault(g, []).append(measures(text))
    out = {}
    for g, rows in by.items():
        if len(rows) < rules.LEAST:
            continue
        out[g] = []
        for k, column in enumerate(zip(*rows)):
            x = sorted(column)

            def at(p):
                i = p * (len(x) - 1)
                return x[int(i)] + (i - int(i)) * (x[min(int(i) + 1, len(x) - 1)] - x[int(i)])

            low, mid, high = at(rules.TAIL), at(0.5), at(1 - rules.TAIL)
            low, high = min(low - rules.MARGIN * (mid - low), mid - rules.SLACK[k]), max(high + rules.MARGIN * (high - mid), mid + rules.SLACK[k])
            out[g].append((0.0 if k == 2 else low, 1.0 if k == 3 else high))
    return out


def test_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = rules.op8_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    bands, vocab = groups(docs.values()), rules.vocabularies(*VOCAB)
    assert len(bands) >= 2
    for r in rows:
        own = measures(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(docs[r.doc_id].text)
        assert np.allclose([r[c] for c in rules.MEASURES], own)
        band = bands.get((r.script, docs[r.doc_id].lang)) or bands.get((r.script, None)) or vocab.bands[r.script]
        bad = next((c for c, x, (low, high) in zip(rules.MEASURES, own, band) if not low - 1e-9 <= x <= high + 1e-9), None)
        assert r.rejected_by == ("base" if r.base_failed else bad) and r.kept == (r.rejected_by is None)
    by = Counter(r.rejected_by for r in rows)
    assert sum(n for c, n in by.items() if c in rules.MEASURES) >= 2, by


def test_rules_don_t_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (rules.fit(d, VOCAB, lang="lang", least=20) for d in (docs, docs.unionByName(docs).repartition(7)))
    assert one and one == two


def test_every_text_fits_the_bands(spark):
    """More texts than the 20,000 that fitted before: bands are the quantiles of all, those of languages and of scripts."""
    rnd = __import__("random").Random(3)
    words = ["".join(rnd.choice("aeioubcdfgklmnprst") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rnd.sample(words, 12)) for _ in range(20_600)]
    df = spark.createDataFrame([(t, "x" if i % 4 else None) for i, t in enumerate(texts)], "text string, lang string")
    bands = rules.fit(df.unionByName(df.limit(500)).repartition(4), VOCAB, lang="lang")
    assert set(bands) == {("latin", "x"), ("latin", None)}
    out = rules.measure(texts, rules.vocabularies(*VOCAB))
    assert not out["base_failed"].any() and len(set(texts)) == len(texts)
    for lang, own in (("x", np.arange(len(texts)) % 4 > 0), (None, np.ones(len(texts), bool))):
        quantiles = np.quantile([out[c][own] for c in rules.MEASURES], (rules.TAIL, 0.5, 1 - rules.TAIL), axis=1)
        assert np.allclose(bands["latin", lang], rules.band_of(*quantiles), rtol=1e-12, atol=1e-12)


def test_rules_odd_rows(spark):
    texts = [*ODD, (8, "q w e r t a b c d f g h " + "\U0001f600" * 60, 1), (9, "one two three four five six seven eight nine ten eleven twelve and so on with more of the same sort", 1)]
    df = spark.createDataFrame([(*r, True) for r in texts], "doc_id long, text string, n_words int, kept boolean")
    rows = rules.judge(df, VOCAB).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.kept for r in rows}[8] is False and {r.doc_id: r.kept for r in rows}[9] is True
    assert all(tuple(r[c] for c in (*rules.COUNTS, "base_failed")) in {base(t) for _, t, _ in texts} for r in rows)
    assert rules.judge(df.limit(0), VOCAB).count() == 0


CLEAN = {
    "gujarati": "પ્રતિષ્ઠા અને અધિકારોની દૃષ્ટિએ સર્વ માનવો જન્મથી સ્વતંત્ર અને સમાન હોય છે તેમનામાં વિચારશક્તિ અને અંતઃકરણ હોય છે",
    "gurmukhi": "ਸਾਰਾ ਮਨੁੱਖੀ ਪਰਿਵਾਰ ਆਪਣੀ ਮਹਿਮਾ ਸ਼ਾਨ ਅਤੇ ਹੱਕਾਂ ਦੇ ਪੱਖੋਂ ਜਨਮ ਤੋਂ ਹੀ ਆਜ਼ਾਦ ਹੈ",
    "malayalam": "മനുഷ്യരെല്ലാവരും തുല്യാവകാശങ്ങളോടും അന്തസ്സോടും സ്വാതന്ത്ര്യത്തോടുംകൂടി ജനിച്ചിട്ടുള്ളവരാണ് അന്യോന്യം ഭ്രാതൃഭാവത്തോടെ പെരുമാറുവാനാണ് മനുഷ്യന് വിവേകബുദ്ധിയും മനസ്സാക്ഷിയും സിദ്ധമായിരിക്കുന്നത്",
    "telugu": "ప్రతిపత్తిస్వత్వముల విషయమున మానవులెల్లరును జన్మతః స్వతంత్రులును సమానులును నగుదురు వారు వివేదనాంతఃకరణ సంపన్నులగుటచే పరస్పరము భ్రాతృభావముతో వర్తింపవలయును",
    "sinhala": "සියලු මනුෂ්‍යයෝ නිදහස්ව උපත ලබා ඇත ගරුත්වයෙන් හා අයිතිවාසිකම්වලින් සමාන වෙති",
    "lao": "ມະນຸດ ທຸກຄົນ ເກີດມາ ມີກຽດສັກສີ ສິດທິ ເສລີພາບ ແລະ ຄວາມສະເໝີພາບ ເທົ່າທຽມກັນ ທຸກໆຄົນ ມີເຫດຜົນ",
    "ethiopic": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው",
    "kannada": "ಎಲ್ಲಾ ಮಾನವರೂ ಸ್ವತಂತ್ರರಾಗಿಯೇ ಜನಿಸಿದ್ದಾರೆ ಹಾಗೂ ಘನತೆ ಮತ್ತು ಹಕ್ಕುಗಳಲ್ಲಿ ಸಮಾನರಾಗಿದ್ದಾರೆ ವಿವೇಕ ಮತ್ತು ಅಂತಃಕರಣ",
    "myanmar": "လူတိုင်းသည် တူညီ လွတ်လပ်သော ဂုဏ်သိက္ခာဖြင့် လည်းကောင်း တူညီလွတ်လပ်သော အခွင့်အရေးများဖြင့် လည်းကောင်း မွေးဖွားလာသူများ ဖြစ်သည် ထိုသူတို့၌ ပိုင်းခြား",
    "other": "ᏂᎦᏓ ᎠᏂᏴᏫ ᏂᎨᎫᏓᎸᎾ ᎠᎴ ᎤᏂᏠᏱ ᎤᎾᏕᎿ ᏚᏳᎧᏛ ᎨᏒᎢ ᎨᏥᏁᎳ ᎤᎾᏓᏅᏖᏗ ᎠᎴ ᎤᏃᏟᏍᏗ",
}


def test_clean_text_of_any_script_stays():
    import random

    vocab = rules.vocabularies(*VOCAB)
    for script, text in CLEAN.items():
        words = text.split()
        rnd = random.Random(1)
        long = " ".join("".join(rnd.sample(rnd.choice(words), 1) + [rnd.choice(words)]) for _ in range(4000))
        out = rules.measure([text, f"{text} word", long], vocab)
        assert out["script"].tolist() == [script] * 3
        for i in range(3):
            assert all(low <= out[c][i] <= high for c, (low, high) in zip(rules.MEASURES, vocab.bands[script])), (script, i, out)


def test_junk_is_outside_fitted_bands(spark):
    rnd = __import__("random").Random(4)
    words = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(40)), "en") for i in range(300)]
    rows += [(900, "q w e r t a b c d f g h " + "\U0001f600" * 60, "en"), (901, " ".join("".join(rnd.choice("bcdfgxzqkw0189") for _ in range(9)) for _ in range(30)), "en"), (902, "an ordinary text that has one \U0001f600 in it, but is otherwise as the others were and not more than that, as far as one can say", None)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCAB, lang="lang").collect()}
    assert not got[900].kept and not got[901].kept and got[901].rejected_by in rules.MEASURES
    assert sum(got[i].kept for i in range(300)) >= 0.97 * sum(not got[i].base_failed for i in range(300))


def test_quotes():
    text = "Hi Bob,\n\nOn Monday Ann wrote:\n> first line\n>  second line\n> > deeper\n>\n> back\n\nMy answer\n"
    own, quotes = chat.parse(text)
    assert own == "Hi Bob,\n\n\nMy answer"
    assert quotes == [(1, "first line\n second line"), (2, "deeper"), (1, "back")]
    assert chat.parse(None) == ("", []) and chat.parse("a > b") == ("a > b", [])
    assert chat.normal('  "Hello,   WORLD!" ') == "hello, world"


def threads(rows):
    """The same links by nested loops."""
    parsed = [(c, t, *chat.parse(x)) for c, t, _, x in rows]
    known = [(c, t) for c, t, _, _ in parsed if c is not None and t is not None]
    out = []
    for c, t, _, quotes in parsed:
        best = None
        if c is not None and t is not None:
            for level, q in quotes:
                if len(chat.normal(q)) < chat.SHORTEST:
                    continue
                own = [(a, b) for a, b, held, _ in parsed if a is not None and b is not None and chat.normal(q) in chat.holds(held)]
                inside = min([x for x in own if x[0] == c], default=None)
                up = next((x for x in (inside, min(own, default=None)) if x and x < (c, t)), None)
                if up:
                    best = max(best or (-level, up), (-level, up))
        up = best[1] if best else (c, t - 1) if c is not None and t is not None and (c, t - 1) in known else None
        out.append((c, t, up))
    links = dict(((c, t), up) for c, t, up in out)
    full = []
    for c, t, up in out:
        root, depth = (c, t), 0
        while links.get(root):
            root, depth = links[root], depth + 1
        full.append((c, t, *(up or (None, None)), *root, depth))
    return sorted(full, key=repr)


def test_threads(spark):
    rows = [
        (1, 0, "u", "Hello there my dear friend.\nHow is the weather in Paris today?"), (1, 1, "a", "On Monday X wrote:\n> How is the weather in paris   today?\n\nIt is sunny and warm outside."),
        (1, 2, "u", "> > How is the weather in Paris today?\n> It is sunny and warm outside.\nThanks a lot for the answer"), (1, 3, "u", "> Hello there my dear friend.\nhi again to you all"),
        (2, 0, "u", ">Thanks a lot for the answer\nfrom another conversation"), (2, 2, "x", "after a gap"), (None, 1, "u", "> It is sunny and warm outside."), (3, 0, "u", None), (3, 1, "b", ""),
        *[(4, i, "u", f"turn number {i}") for i in range(40)], (4, 40, "u", "> turn number 17"), (0, 5, "u", "> turn number 17"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, own string")
    got = [(r.conv_id, r.turn, r.parent_conv, r.parent_turn, r.root_conv, r.root_turn, r.depth) for r in chat.link(df).collect()]
    assert sorted(got, key=repr) == threads(rows)
    assert all(not re.search(r"^\s*>", r.text, re.M) for r in chat.link(df).collect())
    twice = chat.link(df.unionByName(df))
    assert twice.count() == 2 * len(rows)
    assert chat.link(df.limit(0)).count() == 0


def nested(n=240):
    """Conversations whose replies quote replies, and one message that a third of all quote."""
    hot = "Everybody will come back to this one sentence later on."
    rows = [(0, 0, "user", hot), (0, 1, "assistant", "> " + hot + "\nI shall be the first to answer it here.")]
    for c in range(1, n // 3):
        rows += [(c, 0, "user", f"Question number {c} is about the weather in town {c}."), (c, 1, "assistant", f"> Question number {c} is about the weather in town {c}.\nIt rains there for {c} days."), (c, 2, "user", f"> > Question number {c} is about the weather in town {c}.\n> It rains there for {c} days.\n\n> {hot}\nThat is long.")]
    return rows


def test_registered_query_on_nested_quotes(spark, tmp_path):
    rows = nested()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op7_quotation_links(spark, str(tmp_path)).collect()
    full = [(r.conv_id, r.turn, r.parent_conv, r.parent_turn, r.root_conv, r.root_turn, r.depth) for r in got]
    assert sorted(full, key=repr) == threads(rows)
    assert sum(r.by_quote for r in got) >= len(rows) // 2 and not any(">" in r.text for r in got)
    trees = {}
    for r in got:
        trees.setdefault((r.root_conv, r.root_turn), []).append(r)
    for tree in trees.values():
        tree.sort(key=lambda r: r.position)
        assert [r.position for r in tree] == list(range(len(tree)))
        place = {(r.conv_id, r.turn): r.position for r in tree}
        assert all(r.parent_turn is None or place[r.parent_conv, r.parent_turn] < r.position for r in tree)
        assert [(r.depth, r.conv_id, r.turn) for r in tree] == sorted((r.depth, r.conv_id, r.turn) for r in tree)


def test_trimmed_and_short_quotes(spark):
    body = "The first line of it\nthe second line follows\nand a third line ends.\n\nAnother paragraph here\n\nYes, I do.\n\nThe fourth paragraph says more\n\nThe fifth one closes"
    lines = [x for x in body.split("\n") if x]
    runs = [lines[i:j] for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
    rows = [(1, 0, body), (1, 1, "Something else entirely"), (1, 2, "No line of the first")]
    rows += [(1, 10 + 2 * k, "\n".join(f"> {x}" for x in run) + "\nan answer") for k, run in enumerate(runs)]
    rows += [(2, 5 + 2 * k, "\n".join(f"> {x}" for x in run) + "\nan answer") for k, run in enumerate(runs)]
    rows += [(1, 900, "> Yes, I did.\nno such line"), (1, 902, "> The first line of it\n> [...]\n> The fifth one closes\nparts"), (1, 904, "> Something else entirely\n> words of nobody\nparts")]
    rows += [(1, 906, "> The first line\n> of it the second line follows and a third line ends.\nwrapped anew")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r for r in chat.link(df).collect()}
    whole = [(c, t, chat.normal(chat.parse(x)[0])) for c, t, x in rows]
    for c, t, x in rows[3:-4]:
        quote = chat.normal(chat.parse(x)[1][0][1])
        held = [(a, b) for a, b, own in whole if quote in own and (a, b) < (c, t) and (len(quote) >= chat.SHORTEST or a == c)]
        want = min(held) if held else None
        r = got[c, t]
        assert ((r.parent_conv, r.parent_turn) if r.by_quote else None) == want, (c, t, quote)
        assert r.n_quotes == 1
    assert not got[1, 900].by_quote
    assert [(got[1, t].by_quote, got[1, t].parent_turn) for t in (902, 904, 906)] == [(True, 0), (True, 1), (True, 0)]


def test_url_verdicts(spark, sf, tmp_path, monkeypatch):
    import random

    rnd = random.Random(1)
    hosts = [f"h{i}.example.{t}" for i in range(25) for t in ("com", "net", "org")]
    rows = [(i, f"https://{rnd.choice(hosts)}/{rnd.choice(['en', 'es', 'fr', 'de'])}/{rnd.randint(1, 99)}", " ".join(f'<a href="{rnd.choice(["http:", "https:", ""])}//{rnd.choice(hosts)}/x">' for _ in range(rnd.randint(0, 4))), "x") for i in range(250)]
    rows += [(900 + i, f"http://spam.example.org/es/{i}", '<a href="//h1.example.net/">', None) for i in range(4)] + [(None, None, None, None), (1, "no scheme", "", ""), (1, "no scheme", "", ""), (2, "HTTP://A.ORG/es/x?y#z", "<A HREF=//spam.example.org/q>", ""), (3, "x://COM/en/a", None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    con = duckdb.connect()
    pages = df.toPandas()
    con.register("pages", pages)
    want = con.execute(urls.sql()).fetchall()
    cols = [c[0] for c in con.description]
    got = [tuple(r[c] for c in cols) for r in urls.judge(df).collect()]
    clean = lambda rs: sorted(repr(tuple(None if isinstance(x, float) and math.isnan(x) else int(x) if isinstance(x, float) else x for x in r)) for r in rs)
    assert clean(got) == clean(want) and {"allow", "block"} == {r[cols.index("verdict")] for r in got}
    assert any(r[cols.index("rule")] is None and r[cols.index("verdict")] == "block" for r in got)
    assert urls.judge(df.limit(0)).count() == 0
    monkeypatch.setattr(urls, "FEW_RULES", 2)  # the join of many rules
    assert clean(tuple(r[c] for c in cols) for r in urls.judge(df).collect()) == clean(want)


def test_url_rules_of_the_contract(spark, tmp_path):
    """The verdict and rule that the contract's list gives to urls that fit a rule, in the registered query and in its SQL."""
    want = {
        "http://com/en/1": ("com/en/", "block"), "http://a.example.com/en/6": ("com/en/", "block"), "https://EXAMPLE.com/en/7?q": ("example.com/en/7", "allow"), "http://a.example.com/en/71": ("example.com/en/7", "allow"),
        "http://net/de/1": ("net/de/", "allow"), "http://a.example.net/de/7": ("net/de/", "allow"), "http://other.net/de/8": ("net/de/", "allow"), "http://example.net/de/8#x": ("example.net/de/8", "block"), "http://b.Example.net/de/89": ("example.net/de/8", "block"),
        "http://a.org/es/": ("org/es/", "block"),
    }
    spark.createDataFrame([(i, u, None) for i, u in enumerate(want)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for rows in (urls.op9_url_filter(spark, str(tmp_path)).select("page_id", "rule", "verdict").collect(), con.execute(f"SELECT page_id, rule, verdict FROM ({urls.sql()})").fetchall()):
        assert [tuple(r)[1:] for r in sorted(rows, key=lambda r: r[0])] == list(want.values())


def test_many_rules(spark, monkeypatch):
    rules_ = [("block", "a.com"), ("allow", "a.com/x"), ("block", "com/xy"), ("allow", "b.a.com/"), ("allow", "a.com/x"), ("block", "a.com/x")]
    rows = [(h, p) for h in ("a.com", "b.a.com", "ba.com", "c.com", "com", "", ".com") for p in ("", "/", "/x", "/xy", "/xyz", "/y")]
    df = spark.createDataFrame(rows, "host string, path string")
    few = sorted(map(repr, urls.with_rule(df, rules_).selectExpr("host", "path", "found.rule", "found.action").collect()))
    monkeypatch.setattr(urls, "FEW_RULES", 0)
    assert sorted(map(repr, urls.with_rule(df, rules_).selectExpr("host", "path", "found.rule", "found.action").collect())) == few
    table = spark.createDataFrame(rules_, "action string, rule string")
    assert sorted(map(repr, urls.with_rule(df, table).selectExpr("host", "path", "found.rule", "found.action").collect())) == few


def test_propagation_by_brute_force(spark):
    """Personalised PageRank with fractions over a graph of three kinds of hosts, and the verdicts that follow."""
    import random

    rnd = random.Random(8)
    hosts = [f"good{i}.example.com" for i in range(6)] + [f"bad{i}.org" for i in range(6)] + [f"h{i}.net" for i in range(30)]
    pages = []
    for h in hosts:
        kind = "en/7" if h.startswith("good") else "es" if h.startswith("bad") else "xx"
        for i in range(rnd.randint(1, 4)):
            to = rnd.sample(hosts, rnd.randint(0, 5))
            pages.append((len(pages), f"http://{h}/{kind}/{i}", " ".join(f'<a href="http://{x}/">' for x in to)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    share = {}
    for h in hosts:
        own = [u for _, u, _ in pages if f"//{h}/" in u]
        share[h] = (sum("/en/7" in u for u in own) / len(own) if h.startswith("good") else 0.0, 1.0 if h.startswith("bad") else 0.0)
    edges = {(re.search("//([^/]+)", u)[1], x) for _, u, t in pages for x in re.findall('http://([^/]+)/"', t)}
    edges = {(a, b) for a, b in edges if a != b}
    whole = sum(a + b for a, b in share.values())

    def rank(edges, seed):
        out = {}
        for a, _ in edges:
            out[a] = out.get(a, 0) + 1
        start = {h: 0.15 * seed[h] / whole for h in hosts}
        mass = dict(start)
        for _ in range(300):
            now = dict(start)
            for a, b in edges:
                now[b] += 0.85 * mass[a] / out[a]
            mass = now
        return mass

    trust = rank(edges, {h: share[h][0] for h in hosts})
    distrust = rank({(b, a) for a, b in edges}, {h: share[h][1] for h in hosts})
    limit = {h: trust[h] + 0.15 * (1 - sum(share[h])) / whole for h in hosts}
    want = {h for h in hosts if distrust[h] > limit[h] * 1.001}
    left: list[float] = []
    got = {r.host: r for r in urls.blocked_hosts(df, urls.RULES, residuals=left).collect()}
    sure = {h for h in hosts if abs(distrust[h] - limit[h]) > 0.001 * limit[h]}
    assert set(got) & sure == want & sure and any(h.startswith("h") for h in want) and len(want) < len(hosts)
    assert all(abs(r.distrust / urls.SCALE - distrust[h]) < 1e-3 * distrust[h] for h, r in got.items())
    assert len(left) == 2 and all(x <= 0.85**urls.ROUNDS for x in left)


def test_masses_of_ten_million_pages_and_seeds(spark):
    one = spark.range(10_000_000).selectExpr("id as page_id", "concat('http://hot.org/es/', id) as url", "cast(null as string) as html")
    many = spark.range(200_000).selectExpr("id as page_id", "concat('http://h', id, '.org/es/') as url", "'<a href=//hub.net/>' as html")
    assert [tuple(r) for r in urls.blocked_hosts(one, urls.RULES).collect()] == [("hot.org", 0, urls.SCALE * 15 // 100)]
    assert urls.blocked_hosts(many, urls.RULES).count() == 200_000


def test_no_python_in_the_url_plan(spark, sf):
    assert not re.search("Python|Pandas|Arrow", urls.op9_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString())


def test_archives(spark, tmp_path):
    html = ["<p>a</p>", "", None, "é" * 400_000, "<p>a</p>", "<p>a</p>\r\n\r\nWARC/1.1", "<p>a</p>"]
    rows = [(i if i != 4 else None, f"http://x/{i}\r\nInjected: 1" if i else None, h, "response", 7) for i, h in enumerate(html)] + [(6, "http://x/6", "<p>a</p>", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, digest int").repartition(2)
    folder = shared_path(spark, "warc-test")
    index = warc.write(df, folder, frame_bytes=600)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(index, folder).collect()), key=repr)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = []
    for i, _, h, _, _ in rows:
        first = max((j for j, _, g, _, _ in rows if (g or "") == (h or "") and j is not None), default=None)
        same = sum((g or "") == (h or "") for _, _, g, _, _ in rows)
        revisit = same > 1 and i != first
        want.append((i, "revisit" if revisit else "response", first if revisit else None, len((h or "").encode()), digest(h)))
    assert got == sorted(want, key=repr)
    for r in index.where("page_id = 3").collect():
        head, block = warc.fetch(folder, r.bundle, r.frame_at, r.frame_bytes, r.at)
        assert head["WARC-Record-ID"] == "<urn:page:3>" and block.endswith(("é" * 400_000).encode()) and "\n" not in head["WARC-Target-URI"]
    files, root = warc.store(folder)
    for name in {r.bundle for r in index.collect()}:
        import zstandard

        with files.open_input_file(f"{root}/{name}") as f:
            table = warc.seek_table(f)
            f.seek(0)
            whole = f.read()
        plain = b"".join(zstandard.ZstdDecompressor().decompress(whole[a : a + n]) for a, n, _ in table)
        assert len(plain) == sum(x[2] for x in table) and zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == plain
    kept = shared_path(spark, "warc-test")
    assert {r.record_type for r in warc.read(warc.write(df, kept, least=10**7), kept).collect()} == {"response"}
    none = shared_path(spark, "warc-test")
    assert warc.read(warc.write(df.limit(0), none), none).count() == 0


def test_reading_back_takes_as_many_tasks_as_bytes_ask_for(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 1 << 16)
    df = spark.range(400).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(string(id), 400) as html")
    folder = shared_path(spark, "warc-test")
    got = warc.read(warc.write(df, folder, frame_bytes=4096), folder)
    assert got.rdd.getNumPartitions() >= 6 and got.count() == 400


def test_archive_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(warc.SQL).fetchall()
    cols = [c[0] for c in con.description]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in warc.op10_warc(spark, sf).collect()))) == sorted(map(repr, want))


def test_pipeline(spark, sf):
    import corpus_pipeline as C
    from strataframe.llm import jaccard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in C.STAGES[:-1]:
        out = jaccard.materialize(stage(spark, kept, sf), "test")
        assert out.columns == docs.columns and 0.5 * kept.count() < out.count() <= kept.count()
        assert out.exceptAll(kept).count() == 0
        kept = out
    pieces_ = C.run(spark, sf).collect()
    assert {r.doc_id for r in pieces_} == {r.doc_id for r in kept.collect()}
    assert json.dumps([n for n, _ in C.STAGES])
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for _, stage in C.STAGES:
        stage(spark, odd, sf).count()
        stage(spark, docs.limit(0), sf).count()


def test_pipeline_keeps_clashing_columns(spark, sf, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.selectExpr("*", "concat('s', doc_id) as score", "string(doc_id) as spans", "doc_id % 3 as lang_pred", "array(doc_id) as row", "doc_id as key", "source as hi", "text as _text", "struct(doc_id) as rest")
    want = {r.doc_id: r for r in extra.collect()}
    kept = extra
    for _, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == extra.columns and kept.schema.simpleString() == extra.schema.simpleString()
        rows = kept.collect()
        assert rows and all(r == want[r.doc_id] for r in rows)
    assert C.STAGES[-1][1](spark, kept, sf).count() >= len(rows)


def test_tables_go_with_their_block_only(spark, sf):
    from strataframe.llm import common, jaccard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files = lambda: set(spark._jvm.org.apache.hadoop.fs.Path(common.shared_root(spark)).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_root(spark)}/strataframe")))
    other = jaccard.distinct(docs)
    before = len(files())
    with common.tables(spark):
        n = jaccard.distinct(docs).count()
        assert len(files()) > before
    assert len(files()) == before and other.count() == n
