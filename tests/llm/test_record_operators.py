"""Names, conversations, privacy, mixing: against brute force on small fixtures."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import components, dialogue, mixing, names, privacy
from docketry.llm.queries import queries
from docketry.llm.sql import oracle_sql
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, data, name):
    assert_same(queries()[name](spark, data), data, oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(spark, data, name):
    assert queries()[name](spark, data).count() > 0


# --- components ----------------------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loners(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)] + [("hub", f"leaf{i}") for i in range(200)] + [("x", "x")]
    nodes = {n for e in edges for n in e} | {"alone"}
    got = {r.node: r.component for r in components.connected(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"c{i:03}"] for i in range(101)} == {"c000"} and len({got[f"leaf{i}"] for i in range(200)} | {got["hub"]}) == 1
    assert got["alone"] == "alone" and got["x"] == "x"


# --- names ---------------------------------------------------------------------------------------------------------

PEOPLE = "id string, full_name string, organization string, email string, phone string"


def pairs(spark, rows, kind="person"):
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], PEOPLE).withColumn("class", F.lit("clash")).repartition(3)
    return {(r.key_a, r.key_b) for r in names.links(df).filter(F.col("kind") == kind).collect()}


def test_spellings_of_one_person(spark):
    org = "Felsol Tagopa Logistics LLP"
    rows = [("1", "Patricia Rudiyar", org), ("2", "TRISH RUDIYAR", org), ("3", "Rudiyar, Patricia A.", org), ("4", "Dr. P. Rudiyar", org), ("5", "Patricia Rudyiar", org), ("6", "Patricia Rudiyar", "Other Name Foods Ltd"), ("7", "Walter Rudiyar", "Felsol Tagopa Logistics"), ("8", None, org), ("9", "", org), ("1", "Patricia Rudiyar", org)]
    # 4 could be Patricia only: Walter has another initial
    assert pairs(spark, rows) == set(itertools.combinations("12345", 2))


def test_an_initial_that_fits_two_people_links_neither(spark):
    rows = [("1", "Robert Silva", "A Bcdef Foods"), ("2", "Rebecca Silva", "A Bcdef Foods"), ("3", "R. Silva", "A Bcdef Foods")]
    assert pairs(spark, rows) == set()


def test_missing_organisation_needs_a_shared_contact(spark):
    rows = [("1", "Ivy Vanere", None, "Ivy@x.test", None), ("2", "Ivy Vnere", "", "ivy@X.test", "(00) 867-4626"), ("3", "I. Vanere", "Zol Foods Ltd", None, "008674626"), ("4", "Ivy Vanere", None, None, None), ("5", "Nora Other", None, "ivy@x.test", None), ("6", "Ivy Vanere", "Kor Foods Ltd", "else@x.test", None)]
    assert pairs(spark, rows) == {("1", "2"), ("2", "3"), ("1", "3")}


def test_organisation_strings(spark):
    orgs = ["Casdi Zanruku Foods Inc", "Casdi-Zanruku Fds, Incorporated", "Foods Casdi Zanruku", "CASDI ZANRUKU", "Casdi Zanruku Shipping plc", "Csadi Zanruku Foods", "Bofo Mibeker Advogados Associados S.A.", "Bofo Mibeker Adv. Assoc. S/A", " ", ""]
    rows = [(str(i), f"Name{i} Family{i}", o) for i, o in enumerate(orgs)]
    got = pairs(spark, rows, "organization")
    foods = sorted([orgs[0], orgs[1], orgs[2], orgs[5]])
    want = set(itertools.combinations(foods, 2)) | {tuple(sorted((orgs[6], orgs[7])))}
    assert got == want  # the name without a line fits two organisations, so it stays alone


@pytest.mark.parametrize("a, b", [("jenny", "jennifer"), ("nick", "nicholas"), ("chris", "christopher"), ("gus", "august"), ("peggy", "margaret")])
def test_short_forms_meet_under_a_contact(a, b):
    assert names.same_person(a, ["smith"], b, ["smith"], True)


@pytest.mark.parametrize("a, b", [("john", "joan"), ("karin", "karen"), ("erik", "erika"), ("dana", "dara")])
def test_names_that_lie_close_stay_apart(a, b):
    assert names.same_person(a, ["smith"], b, ["smith"], False) == names.same_person(a, ["smith"], b, ["smith"], True) == 0


def test_bearers_tell_a_slip_from_a_name():
    assert names.same_person("dana", ["smith"], "dara", ["smith"], False, 900, 3) == 2
    assert names.same_person("jhon", ["smith"], "john", ["smith"], False, 300, 400) == 0


def test_a_family_of_short_forms(spark):
    org = "Felsol Tagopa Logistics LLP"
    rows = [("1", "Jennifer Smith", org), ("2", "Jenny Smith", org), ("3", "J. Smith", org), ("4", "John Miller", org), ("5", "Joan Miller", org), ("6", "Gus Miller", None, "m@x.test"), ("7", "August Miller", org, "m@x.test")]
    assert pairs(spark, rows) == {("1", "2"), ("1", "3"), ("2", "3"), ("6", "7")}


def test_legal_forms_of_many_countries(spark):
    orgs = ["Casdi Zanruku B.V.", "Casdi Zanruku Oy", "Casdi Zanruku S.p.A.", "Casdi Zanruku Pty Ltd", "Casdi Zanruku Co.", "Casdi Zanruku"]
    rows = [(str(i), f"Name{i} Family{i}", o) for i, o in enumerate(orgs)]
    assert pairs(spark, rows, "organization") == set(itertools.combinations(sorted(orgs), 2))


def test_slips_against_the_textbook():
    def osa(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        assert names.slips(a, b) == min(osa(a, b), 3)


def test_a_name_held_by_very_many_rows(spark):
    rows = [(f"{i:04}", "Ana Costa", "Zol Bekafe Foods") for i in range(60)]
    assert len(pairs(spark, rows)) == 60 * 59 // 2


def test_no_people(spark):
    assert names.links(spark.createDataFrame([], PEOPLE)).count() == 0


# --- conversations -------------------------------------------------------------------------------------------------

MESSAGES = "id string, conversation_id string, role string, content string, error string, created_at string, seq long"


def plain_verdict(messages, known):
    """The rules, one conversation at a time."""
    out = set()
    rows = {m[0]: m for m in messages}.values()
    for c in {m[1] for m in rows} | known:
        own = [m for m in rows if m[1] == c]
        roles = [(m[2] or "?").strip().lower() for m in own]
        turns = [(m[5], m[6], r) for m, r in zip(own, roles) if r in ("user", "assistant") and (m[3] or "").strip() and not m[4]]
        seq = [r for *_, r in sorted(turns)] if all(m[5].startswith("20") for m in own) else []
        bad = c not in known or any(r not in ("user", "assistant", "system") for r in roles) or any(not m[5].startswith("20") for m in own)
        if bad or not seq or seq[-1] != "assistant" or seq[0] == "assistant" or any(a == b == "assistant" for a, b in zip(seq, seq[1:])):
            out.add(c)
    return out


def test_verdicts_against_plain_rules(spark):
    rnd = random.Random(9)
    rows = []
    for c in range(120):
        for k in range(rnd.choice([0, 1, 2, 4, 4, 6, 9])):
            role = ["user", "assistant"][k % 2] if rnd.random() < 0.9 else rnd.choice(["user", " Assistant", "SYSTEM", "tool", None])
            rows.append((f"m{c}-{k}", f"c{c}", role, rnd.choice(["hi"] * 12 + ["", " ", None]), rnd.choice([None] * 12 + ["", "HTTP 4"]), "yesterday" if rnd.random() < 0.01 else f"2020-01-{1 + k // 3:02}T00:00:00Z", k))
    rows += rows[:40]
    known = {f"c{c}" for c in range(118)} | {"empty"}
    got = {r.conversation_id for r in dialogue.verdicts(spark.createDataFrame(rows, MESSAGES).repartition(5), spark.createDataFrame([(c,) for c in known], "id string")).filter("reason IS NOT NULL").collect()}
    assert got == plain_verdict(rows, known)


def test_one_hot_conversation_is_judged_across_partitions(spark):
    rows = [(f"m{k}", "hot", ["user", "assistant"][k % 2], "x", None, f"2020-01-01T{k // 3600:02}:{k // 60 % 60:02}:{k % 60:02}+00:00", k) for k in range(5000)]
    conv = spark.createDataFrame([("hot",)], "id string")
    df = spark.createDataFrame(rows, MESSAGES).repartition(7)
    assert dialogue.verdicts(df, conv).first().reason is None
    out = dialogue.turns(df, conv).orderBy("turn").collect()
    assert [r.turn for r in out] == list(range(1, 5001)) and [r.seq for r in out] == list(range(5000))
    broken = df.filter("seq <> 2500")
    assert dialogue.verdicts(broken, conv).first().reason == "broken order"


def test_offsets_and_ties(spark):
    rows = [("a", "c", "assistant", "x", None, "2020-01-01T01:00:00+02:00", 2), ("b", "c", "user", "x", None, "2019-12-31T22:30:00.5Z", 9), ("d", "e", "user", "x", None, "2020-01-01T00:00:00Z", 1), ("f", "e", "assistant", "x", None, "2020-01-01T00:00:00Z", 2)]
    got = dialogue.verdicts(spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([("c",), ("e",)], "id string")).collect()
    assert all(r.reason is None for r in got)
    none = dialogue.verdicts(spark.createDataFrame([], MESSAGES), spark.createDataFrame([], "id string"))
    assert none.count() == 0


KEY = b"key of the tests"

# --- privacy -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to ana.b@x.test or bob [at] mail [dot] example.", ["email", "email"]),
        ("Lot 225-64-2920 passed; meter 6379 621 986; paid EUR 377,474 on 11.05.2018", []),
        ("SSN 903-62-2129 and CPF 164.676.802-78, NI number QQ 17 60 61 C", ["id_number"] * 3),
        ("Call (11) 90000-9127, +49 (0)30 23125 129 or 020 7946 0016 ext. 99.", ["phone"] * 3),
        ("He lives at Flat 3, 136 Fifel Lane, Bidunville, not at Calle Nito, 48, 2.º B, 60732 Lazihaven.", ["address"] * 2),
        ("The van was left at the corner of Fose Street and never collected.", []),
        ("Per Mr. Litike's call, Ivy Numofa and B. Duntava spoke. Rebecca left.", ["name"] * 3),
        ("Soldastraße 167, 53666 Liviville; 173, rue de Ulmpi, 47556 Zusuberg", ["address"] * 2),
        (None, []), ("", []), ("compare @case-5/board minute.pdf with the lease", []),
    ],
)
def test_mentions(text, want):
    assert [k for k, *_ in privacy.mentions(text)] == want


def test_texts_without_anything_to_find_are_not_scanned(monkeypatch):
    read, scan = [], privacy._scan
    monkeypatch.setattr(privacy, "_scan", lambda text, *rest: read.append(text) or scan(text, *rest))
    texts = ["The van was left at 7 and never collected.", "Olga Petrenko called.", "Lot 225-64-2920 passed; page 3.", None, "Ring +49 30 23125129."]
    batch = pa.RecordBatch.from_arrays([pa.array(["people"] * 5), pa.array([str(i) for i in range(5)]), pa.array(texts, pa.string())], names=["src", "record_id", "text"])
    found = [(r["record_id"], r["kind"], r["value"]) for out in privacy._find(iter([batch])) for r in out.to_pylist() if r["nth"]]
    assert found == [("1", "name", "Olga Petrenko"), ("4", "phone", "+49 30 23125129")] and read == [texts[1], texts[4]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("at\u00a0136\u2003Fifel\u00a0Lane", ["address"]), ("Fóse\u0131straße\u3000١٦٧", ["address"]), ("CPF\u00a0١٦٤676802", ["id_number"]), ("Tel. +٤٩ ٣٠ ٢٣١٢٥١٢٩", ["phone"]),
        ("a＠b.test", ["email"]), ("Mr.Olga Petrenko", ["name"]), ("J.-P. van der Hartley", ["name"]), ("O’Connor Petrenko-łódź", ["name"]), ("佐々木 一さん", ["name"]), ("frau. ölbaumis", ["name"]),
    ],
)
def test_foreign_signs_pass_the_sieve(text, want):
    assert [k for k, *_ in privacy.mentions(text)] == want


# None of these names occurs in a table of the tests.
@pytest.mark.parametrize(
    "text, want",
    [
        ("Spoke to Olga Petrenko and Kenji Tanaka; mail from Priya Raghunathan.", ["Olga Petrenko", "Kenji Tanaka", "Priya Raghunathan"]),
        ("Karen Whitfield called. Signed: Stephen Alexander Grant Whitfield", ["Karen Whitfield", "Stephen Alexander Grant Whitfield"]),
        ("Говорил с Мария Иванова-Петрова, подпись: Иван Петров", ["Мария Иванова-Петрова", "Иван Петров"]),
        ("Ο Γιώργος Παπαδόπουλος ήρθε; είδα τον κ. και τη Μαρία Νικολάου.", ["Γιώργος Παπαδόπουλος", "Μαρία Νικολάου"]),
        ("Maria Helena da Silva Santos Oliveira reside aqui, com Mr Brian O'Connor e Frau Dr. Anne-Sophie Müller-Lüdenscheidt.", ["Maria Helena da Silva Santos Oliveira", "Mr Brian O'Connor", "Frau Dr. Anne-Sophie Müller-Lüdenscheidt"]),
        ("Ludwig van der Berg's keys; J. R. Hartley and P. Hartley", ["Ludwig van der Berg", "J. R. Hartley", "P. Hartley"]),
        ("MARIA WHITFIELD signed, THE DEED IS VOID.", ["MARIA WHITFIELD"]),
        ("田中太郎様と鈴木さん", ["田中太郎", "鈴木"]),
        ("Olga Petrenko Ltd, Olga Petrenko & Sons and Whitfield Holdings plc; Karen Whitfield Street; in New Haven; the Purchase Agreement; Der Schaden; See Art. 5", []),
        ("Call Karen Whitfield Monday, Clause 3.", ["Karen Whitfield"]),
    ],
)
def test_names_of_people_no_table_knows(text, want):
    assert [text[a:b] for k, a, b in privacy.mentions(text) if k == "name"] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Cadastro: isabel pexbranosk / passport no.", ["isabel pexbranosk"]),
        ("Per joão mulavi's call; mr. litike and maria da ruzangu spoke, then ivy j. kurenmor.", ["joão mulavi", "mr. litike", "maria da ruzangu", "ivy j. kurenmor"]),
        ("Spoke to ivy Numofa and Hugh Vodu; rebecca left, and the will is signed.", ["ivy Numofa", "Hugh Vodu"]),
        ("Write to maria silva@x.test; rua maria silva 20; hugh zolu plc", []),
    ],
)
def test_names_in_small_letters(text, want):
    assert [text[a:b] for k, a, b in privacy.mentions(text, known=privacy.SMALL_SEEDS | {"ivy", "hugh"}) if k == "name"] == want


GIVEN_NAMES = [("ivy", 5), ("hugh", 5), ("bill", 3)]


def lexicon(spark):
    return spark.createDataFrame(GIVEN_NAMES, "word string, bearers long")


def test_given_names_are_learned_from_a_column_of_names(spark):
    rows = [("Zyta Aa", 1), ("Dr. Zyta Bb", 2), ("Cc, Zyta", 3), ("Zyta Cc", 4), ("Once Only", 5), (None, 6), ("", 7), ("Al B", 8)]
    got = {r.word for r in privacy.given_names(spark.createDataFrame(rows, "full_name string, word int")).collect()}
    assert got == {"zyta"}


def test_ordinary_words_of_the_corpus_are_no_small_letter_names(spark):
    rows = [("cases", "1", "The bill hereunder is open, as hereunder shown."), ("cases", "2", "Paid hereunder."), ("cases", "3", "signed by ivy kurenmor hereunder, SSN 903-62-2129"), ("people", "4", "Ivy Kurenmor and ivy kurenmor")]
    rows = spark.createDataFrame(rows, "src string, record_id string, text string")
    got = sorted((r.record_id, r.kind, r.nth) for r in privacy.found(rows, lexicon(spark), KEY).collect())
    assert got == [("3", "id_number", 1), ("3", "name", 1), ("4", "name", 1), ("4", "name", 2)]
    out = {r.record_id: r for r in privacy.redacted(rows, lexicon(spark), KEY).collect()}
    assert out["3"].text == "signed by [NAME] hereunder, SSN [ID_NUMBER]" and out["4"].text == "[NAME] and [NAME]"
    big, small = out["4"].surrogate_text.split(" and ")
    assert big.lower() == small and out["3"].surrogate_text.startswith(f"signed by {small} hereunder")


def test_redaction_changes_nothing_else(spark):
    text = "Spoke to Ivy Numofa (SSN 903-62-2129).\nMail ivy@x.test, ring 07700 900 779."
    rows = spark.createDataFrame([("messages", "1", text), ("messages", "1", text), ("cases", "1", "Nothing here."), ("people", "2", "Ms Numofa and IVY NUMOFA; Hugh Vodu")], "src string, record_id string, text string")
    out = {(r.src, r.record_id): r for r in privacy.redacted(rows, lexicon(spark), KEY).collect()}
    assert out["messages", "1"].text == "Spoke to [NAME] ([ID_NUMBER]).\nMail [EMAIL], ring [PHONE].".replace("([ID_NUMBER]", "(SSN [ID_NUMBER]")
    assert out["cases", "1"].surrogate_text == "Nothing here." and len(out) == 3
    swapped = out["messages", "1"].surrogate_text
    assert "Ivy" not in swapped and "903" not in swapped and swapped.startswith("Spoke to ") and swapped.endswith(".")
    first = swapped.split("Spoke to ")[1].split(" (")[0]
    assert first.upper() in out["people", "2"].surrogate_text  # the same person, in the other format
    assert f"Ms {first.split()[1]} and" in out["people", "2"].surrogate_text
    assert privacy.found(rows, lexicon(spark), KEY).count() == 7


def test_rows_without_an_id_or_a_text_come_out(spark):
    rows = [("people", None, "Ring 07700 900 779."), ("people", None, "Ring 07700 900 779."), ("people", None, None), ("cases", "1", None), ("cases", "2", ""), ("cases", "3", "x")]
    out = sorted((r.record_id or "", r.text or "") for r in privacy.redacted(spark.createDataFrame(rows, "src string, record_id string, text string"), lexicon(spark), KEY).collect())
    assert out == [("", ""), ("", "Ring [PHONE]."), ("", "Ring [PHONE]."), ("1", ""), ("2", ""), ("3", "x")]
    none = spark.createDataFrame([], "src string, record_id string, text string")
    assert privacy.redacted(none, lexicon(spark), KEY).count() == 0 and privacy.found(none, lexicon(spark), KEY).count() == 0


def test_surrogates_keep_type_script_and_distinctness(spark):
    values = ["J. Smith", "P. Smith", "John Smith", "Mr John Smith", "JOHN SMITH", "Иван Петров", "Μαρία Νικολάου", "田中太郎", "Maria da Silva", "Mr Brian O'Connor"]
    rows = [("name", v) for v in values] + [("id_number", "164.676.802-78"), ("id_number", "34602958X"), ("phone", "+49 30 123456"), ("phone", "0049-30-123456")]
    got = {r.value: r.surrogate for r in privacy.entity_surrogates(spark.createDataFrame(rows, "kind string, value string"), KEY).collect()}
    assert got["J. Smith"] != got["P. Smith"] and got["J. Smith"].split()[1] == got["P. Smith"].split()[1] == got["John Smith"].split()[1]
    assert got["Mr John Smith"] == f"Mr {got['John Smith']}" and got["JOHN SMITH"] == got["John Smith"].upper()
    assert [privacy.script(got[v]) for v in ("Иван Петров", "Μαρία Νικολάου", "田中太郎")] == ["C", "G", "H"] and got["Maria da Silva"].split()[1] == "da"
    assert got["+49 30 123456"].startswith("+49 ") and got["0049-30-123456"].startswith("0049-")
    d = [int(c) for c in got["164.676.802-78"] if c.isdigit()]
    for n in (9, 10):
        rest = sum(x * w for x, w in zip(d[:n], range(n + 1, 1, -1))) % 11
        assert d[n] == (0 if rest < 2 else 11 - rest)
    assert "TRWAGMYFPDXBNJZSQVHLCKE"[int(got["34602958X"][:8]) % 23] == got["34602958X"][8]
    assert not set(got.values()) & set(got)


def test_the_key_is_needed_and_stays_out_of_the_plan(spark):
    rows = spark.createDataFrame([("name", "Ivy Fam")], "kind string, value string")
    plan = privacy.entity_surrogates(rows, b"topsecret")._jdf.queryExecution().toString()
    assert "topsecret" not in plan and b"topsecret".hex() not in plan
    with pytest.raises(TypeError):
        privacy.redacted(rows, lexicon(spark))


def test_surrogates_stay_distinct(spark):
    values = [("phone", f"07700 900 {i:03}") for i in range(300)] + [("name", f"Ivy Fam{i}") for i in range(300)]
    got = privacy.entity_surrogates(spark.createDataFrame(values, "kind string, value string"), b"k").collect()
    assert len(got) == 600 and len({(r.kind, r.surrogate) for r in got}) == 600
    assert not {r.surrogate for r in got} & {r.value for r in got}


# --- mixing --------------------------------------------------------------------------------------------------------


def test_weights_meet_the_target_or_the_limit():
    draw, *_ = mixing.weights(1000, [0.5, 0.3, 0.2], [2000, 2000, 2000], [1, 1, 1])
    assert [round(d) for d in draw] == [500, 300, 200]
    draw, exponent, how, tilt = mixing.weights(1000, [0.5, 0.3, 0.2], [100, 3000, 1000], [2, 1, 1])
    assert round(draw[0]) == 200 and round(sum(draw)) == 1000 and abs(sum(tilt) - 1) < 1e-9
    # what the limited source gives up goes to the others by their tempered weights
    assert abs((draw[1] - 300) / (draw[2] - 200) - tilt[1] / tilt[2]) < 1e-6 and tilt[1] > tilt[2]
    draw, *_ = mixing.weights(10_000, [0.5, 0.5, 0.0], [100, 0, 50], [2, 3, 9])
    assert [round(d) for d in draw] == [200, 0, 0]
    assert mixing.weights(0, [1.0], [5], [1])[0][0] == 0 and mixing.weights(10, [], [], [])[0] == []


def test_one_temperature_has_the_entropy_of_the_targets_or_keeps_the_limits():
    shares, target = [0.7, 0.2, 0.1], [0.5, 0.3, 0.2]
    a, how = mixing.temperature(shares, target, [1.0] * 3)
    assert how == "entropy" and 0 < a < 1 and abs(mixing.entropy(mixing.tempered(shares, a)) - mixing.entropy(target)) < 1e-9
    b, how = mixing.temperature(shares, target, [1.0, 1.0, 0.15])
    assert how == "limit" and a < b < 1 and abs(mixing.tempered(shares, b)[2] - 0.15) < 1e-9
    assert mixing.temperature(shares, target, [1.0, 1.0, 0.01]) == (1.0, "natural")
    sharp, how = mixing.temperature(shares, [0.95, 0.04, 0.01], [1.0] * 3)
    assert how == "entropy" and sharp > 1


def test_capped_sources_draw_their_limit_to_the_last_token():
    for budget in range(1000, 1400):
        (draw, rest), *_ = mixing.weights(budget, [0.7, 0.3], [97, 5000], [3, 1])
        assert draw == 291 and abs(rest - (budget - 291)) < 1e-6


def test_draws_keep_limits_and_shares(spark):
    sizes = spark.createDataFrame([(i, "ab"[i % 3 == 0], 1 + i % 7) for i in range(6000)] + [(9000, "c", 3), (9001, "z", 5), (9002, "a", 0)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.05, 3), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    runs = spark.createDataFrame([(1, 4000), (2, 20000), (3, 900000)], "run_id int, budget_tokens long")
    d = mixing.draws(sizes, targets, runs).cache()
    top = {(r.source): r.u for r in d.groupBy("source").agg(F.max("uses").alias("u")).collect()}
    assert top["a"] == 1 and top["b"] <= 2 and top["c"] == 3 and "z" not in top
    assert d.groupBy("run_id", "doc_id").count().filter("count > 1").count() == 0
    rep = {(r.run_id, r.source): r for r in mixing.shares(sizes, targets, runs).collect()}
    total = sum(r.tokens for r in rep.values() if r.run_id == 1)
    assert 3970 <= total <= 4000 and rep[1, "a"].in_reach and not rep[1, "none"].in_reach and rep[1, "none"].tokens == 0
    assert rep[3, "a"].tokens == rep[3, "a"].source_tokens and rep[3, "b"].tokens == 2 * rep[3, "b"].source_tokens and rep[3, "b"].most_uses == 2
    assert abs(sum(r.reached_share for r in rep.values() if r.run_id == 2) - 1) < 1e-5
    assert mixing.draws(sizes.limit(0), targets, runs).count() == 0
