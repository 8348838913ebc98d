"""Look-alikes, encodings, pieces, tokens: against brute force, round trips and exact comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.llm import lookalike, mojibake, pieces, tokens

TEXTS = [
    None, "", "   ", "The lease’s end – “soon”.", "it's  we've\n\n x 'll don't 'S 12³ ½ ١٢", "日本語のテキスト、です。", "emoji 👩🏽\u200d⚖\ufe0f <|endoftext|>", "a" * 9000, "\u00a0\u3000\t\r\n ", "Ünïcode\u0301 Ё № ﬁ", "\x00\x01 ' '",
]


# --- tokens --------------------------------------------------------------------------------------------------------


def _library():
    lib = pytest.importorskip("tokenizers")
    t = lib.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(spark):
    t = _library()
    rnd = random.Random(3)
    signs = " '  \n\t's're bZé1٣½,.!|\u3000\xa0日本\u200b'd"
    texts = TEXTS + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    n = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, ["doc_id"]).collect()}
    assert n == {i: len(x) for i, x in got.items()}


def test_no_rows_no_ids(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merging_equals_the_slow_way():
    e = tokens.Encoder()

    def slow(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((e.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in e.ranks), default=None)
            if best is None:
                return [e.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rnd = random.Random(5)
    for _ in range(400):
        w = "".join(rnd.choice("aabcdeilnorstéß日") for _ in range(rnd.randint(1, 25))).encode()
        assert tokens.merge_bytes(w, e.ranks) == slow(w)


def test_perfect_hash_is_minimal():
    e = tokens.Encoder()
    assert e.hash.n == len(e.ids) and len(set(e.ids.tolist())) == len(e.ids)


# --- pieces --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(30))
def test_pieces_cover_the_text_within_the_limits(seed):
    rnd = random.Random(seed)
    words = ["word", "and", "longerword", "x" * rnd.choice([1, 30, 3000]), "end.", "clause,", "\n\n", "\r\n", "。"]
    text = rnd.choice(["", "  \n"]) + rnd.choice([" ", ""]).join(rnd.choice(words) for _ in range(rnd.randint(1, 900)))
    got = pieces.spans(text)
    body = text.strip()
    assert not body or (text[got[0][0] : got[-1][1]] == body)
    for k, (s, e, core) in enumerate(got):
        assert e - s <= pieces.LIMIT and 0 <= core - s <= pieces.OVERLAP
        assert k == 0 or core == got[k - 1][1]
    assert (len(got) > 1) == (len(body) > pieces.LIMIT)


def test_cuts_lie_at_natural_boundaries():
    text = "\n\n".join("Sentence one of the paragraph. " * 20 for _ in range(6))
    got = pieces.spans(text)
    assert all(text[core - 1] in "\n " for _, _, core in got[1:])
    assert all(s == core or text[s - 1].isspace() for s, _, core in got[1:])


def test_an_overlap_must_be_smaller_than_the_limit():
    with pytest.raises(ValueError):
        pieces.spans("word " * 50, 20, 20)


def test_items_are_pages_or_text(spark):
    long = "some words here. " * 200
    rows = [("a", long, None), ("b", "x", ["short", long, None, ""]), ("c", long, []), ("d", None, None), ("e", " \n", None), ("a", long, None), (None, long, None)]
    df = spark.createDataFrame(rows, "document_id string, text string, pages array<string>").withColumn("page", F.lit(7))
    assert sorted((str(r.document_id), r.page) for r in pieces.oversized(df).collect()) == [("None", 0), ("a", 0), ("b", 2), ("c", 0)]
    out = pieces.pieces(df).collect()
    assert max(len(r.text) for r in out) <= 1400 and {r.page for r in out if r.document_id == "b"} == {1, 2}
    assert pieces.pieces(df.limit(0)).count() == 0


# --- encodings -----------------------------------------------------------------------------------------------------

GOOD = [
    "A decisão foi suspensa até a conclusão do laudo; não há notícia de acordo. O imóvel tem 24 m².",
    "El daño se valoró en EUR 90; la compañía devolvió el documento. ¿Quién ordenó las obras?",
    "Das Grundstück misst 45 m² und grenzt an die Straße; Verlängerung ist möglich.",
    "L’entrepôt est resté fermé ; les clés manquent encore. « Personne ne nous l’a montré », a déclaré la société.",
    "“We never saw it,” he said – 4 °C ± 1, see § 3 and £1,781. Annexes: ├─ deed └─ photos (2). √(6² + 2²), drawn as ¬.",
    "Ущерб оценён в 2 293 руб., часть суммы ещё не уплачена. Сторона не согласна с пунктом 5.",
    "Το ακίνητο έχει εμβαδόν 122 τ.μ. και βρίσκεται βόρεια της πόλης. Η ζημία εκτιμήθηκε σε 3 €.",
    "審理は第190号室から第5号室に変更された。損害額は見積もられ、一部は未払いである。",
    "Søren Kjærgård drikker øl på Ærø, og Åse køber æbler. Året er gået.",
    "Þórður Guðmundsson fór að sjá það. Ýmir og Ægir eru í húsinu, íþróttir.",
    "Işık ağaçları çok güzel; İstanbul'da yağmur yağıyor. Şu kadının adı Ayşe, ıslak.",
    "Příliš žluťoučký kůň úpěl ďábelské ódy. Nový byt má výhled.",
    "Zażółć gęślą jaźń. Źródło było żółte, łąka też.",
    "Київ є столицею України. Її мешканці люблять ґрунт і їжу. Ще не вмерла.",
    "Byggnaden på Åsgatan är över hundra år; ägaren är okänd.",
    "Ő fűtött, húsvétkor őrült szőlő.",
    "plain ascii text only", "👩🏽\u200d⚖\ufe0f ok ✅",
]


@pytest.mark.parametrize("text", GOOD)
def test_well_read_text_is_left_alone(text):
    assert mojibake.restore(text) == (text, False, "")


def misread(text, right, wrong):
    out = []
    for b in text.encode(right):
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"])
@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_utf8_spans_come_back_even_inside_good_text(wrong, k):
    bad = misread(GOOD[k], "utf-8", wrong)
    new, found, _ = mojibake.restore(bad)
    assert found and new == GOOD[k]
    new, found, _ = mojibake.restore("A plain start. " + bad)
    assert found and new.endswith(GOOD[k])


@pytest.mark.parametrize("times", [2, 3, 5])
@pytest.mark.parametrize("k", [0, 3, 5])
def test_text_broken_many_times_comes_back(k, times):
    bad = GOOD[k]
    for _ in range(times):
        bad = misread(bad, "utf-8", "cp1252")
    assert mojibake.restore(bad)[:2] == (GOOD[k], True)


def test_the_corpus_can_overrule_a_one_byte_step(spark):
    bad = misread("Die Erklärung zur Prämie kam für die Übergabe zu spät an.", "cp1252", "cp850")
    good, found, how = mojibake.restore(bad)
    assert found and how == "one-byte latin" and "Erklärung" in good
    kind = "document_id string, text string, pages array<string>"
    for words, want in (("Erklärung Prämie", good), ("Erklõrung Prõmie spõt", bad), ("nothing known", good)):
        df = spark.createDataFrame([("x", bad, None), *[(f"w{i}", f"{words} here.", None) for i in range(5)]], kind)
        row = mojibake.restored(df).filter("document_id = 'x'").first()
        assert (row.text, row.found) == (want, want == good)
        assert mojibake.wrongly_decoded(df).count() == (want == good)


@pytest.mark.parametrize("k, right, wrong", [(5, "cp1251", "latin-1"), (5, "koi8_r", "cp1251"), (6, "cp1253", "latin-1"), (7, "cp932", "cp1252"), (0, "cp850", "latin-1"), (0, "cp1252", "cp850"), (1, "cp1252", "cp437")])
def test_one_byte_and_shift_jis_texts_are_found_and_mostly_restored(k, right, wrong):
    text = GOOD[k].encode(right, "ignore").decode(right)
    new, found, _ = mojibake.restore(misread(text, right, wrong))
    assert found
    same = sum(a == b for a, b in zip(new, text)) / len(text)
    assert same > 0.9


def test_lost_characters_are_found(spark):
    df = spark.createDataFrame([("a", "lost � here", None), ("b", None, ["fine", None, misread("não", "utf-8", "cp1252")]), ("c", None, None), ("d", "", []), ("a", "lost � here", None)], "document_id string, text string, pages array<string>")
    assert sorted(r.document_id for r in mojibake.wrongly_decoded(df).collect()) == ["a", "b"]
    rows = {r.document_id: r for r in mojibake.restored(df).collect()}
    assert rows["b"].pages == ["fine", None, "não"] and rows["a"].text == "lost � here"
    assert mojibake.wrongly_decoded(df.limit(0)).count() == 0


# --- look-alikes ---------------------------------------------------------------------------------------------------

PLAIN = "The office confirmed the deed at Sasohaven. A copy – first-draft – stays."


def test_pairs_of_one_look(spark):
    full = "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in PLAIN)
    rows = [
        (1, PLAIN), (2, full), (3, PLAIN.replace("fi", "ﬁ")), (4, PLAIN.replace(" ", "\u00a0")), (5, PLAIN.replace("e", "е")), (6, PLAIN.replace("o", "ο")), (7, PLAIN[:9] + "\u200b\u00ad" + PLAIN[9:]), (8, PLAIN.replace("-", "\u2011")),
        (9, PLAIN.upper()), (10, PLAIN.replace("a", "á")), (11, PLAIN), (12, PLAIN.replace("A copy", "А copy")), (13, None), (14, " "), (15, "\u3000"), (16, ""), (17, "n.º 2 m²"), (18, "n.o 2 m2"), (19, "a\nb"), (20, "a b"),
        (21, "na\u00efve"), (22, "nai\u0308ve"), (23, "nai\u200b\u0308ve"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("x")).repartition(4)
    got = {(r.doc_id_a, r.doc_id_b) for r in lookalike.same_look(df).collect()}
    one = [1, 2, 3, 4, 5, 6, 7, 8, 11, 12]
    want = {(a, b) for a in one for b in one if a < b} - {(1, 11)}
    want |= {(21, 22), (21, 23), (22, 23)}
    assert got == want
    text = {r.doc_id: r.text for r in lookalike.canonical(df).collect()}
    assert text[13] is None and text[16] == "" and text[5] == PLAIN and len(text) == len(rows)


def test_real_words_of_other_scripts_stay(spark):
    ru = "Сторона не согласна с пунктом 5 и просит выплатить, а суд в городе."
    el = "Το ακίνητο έχει εμβαδόν και βρίσκεται."
    rows = [(1, ru), (2, ru.replace("пунктом", "пyнктoм")), (3, el), (4, "It reads: 'а' is Cyrillic кв here")]
    got = {r.doc_id: r.text for r in lookalike.canonical(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ru and got[2] == ru and got[3] == el and "кв" in got[4]


def test_many_copies_of_one_text_give_no_pair_among_themselves(spark):
    rows = [(i, "same text here") for i in range(500)] + [(1000, "same text hеre"), (1001, "text here")]
    got = lookalike.same_look(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 500 and got.filter("doc_id_b <> 1000").count() == 0


def test_no_documents(spark):
    assert lookalike.same_look(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sentences_broken_by_two_pairs():
    good = "Договор аренды был подписан сторонами в присутствии нотариуса и передан в архив. Арендатор обязан вернуть помещение в исправном состоянии до конца года. "
    one, two = good.encode("cp1251").decode("cp1252"), good.encode("koi8_r").decode("cp1251")
    for text, want in ((one * 3 + good + two, good * 5), (one * 2 + two, good * 3)):
        assert mojibake.restore(text)[:2] == (want, True)
