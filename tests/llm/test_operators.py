"""The operators against brute force on small inputs, with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from loomline.llm import capping, components, garble, language, lookalike, names, near_dup, packing

ITEM = "id string, sourceId string, qualityScore int, createdAt timestamp, kept boolean, cap int, day string"


def test_capping(spark):
    r, rows = random.Random(1), []
    t0 = datetime(2026, 6, 1)
    for i in range(900):
        who = r.choice([" A", "a ", "b", "c", None]) if i % 3 else "A"
        rows.append((f"i{i:04d}", who, r.choice([None, -5, 150, 10, 50, 50, 90]), t0 + timedelta(minutes=r.randrange(4000)), True, 1, "x"))
    rows += rows[:40] + [(None, "a", 1, t0, None, None, None), ("z", "a", 1, None, None, None, None)]
    got = {x.id: x.kept for x in capping.cap_contributors(spark.createDataFrame(rows, ITEM)).collect()}
    once = {x[0]: x for x in rows if x[0] and x[3]}
    days, groups = defaultdict(int), defaultdict(list)
    for x in once.values():
        days[x[3].date()] += 1
        groups[x[3].date(), x[1].strip().lower() if x[1] else None].append(x)
    want = {}
    for (day, _), xs in groups.items():
        xs.sort(key=lambda x: (-(x[2] if x[2] is not None and 0 <= x[2] <= 100 else -1), x[3], x[0]))
        want |= {x[0]: k < days[day] // 25 for k, x in enumerate(xs)}
    assert got == want
    assert capping.cap_contributors(spark.createDataFrame([], ITEM)).count() == 0


def test_reservoir_keeps_caps_and_prefers_quality(spark):
    rows = [(f"i{i}", "a", 90 if i % 2 else 10, datetime(2026, 6, 1), None, None, None) for i in range(2000)]
    kept = capping.cap_contributors(spark.createDataFrame(rows, ITEM), temperature=20.0).filter("kept").collect()
    assert len(kept) == 80
    assert sum(int(x.id[1:]) % 2 for x in kept) > 70


def test_contract(spark):
    r = random.Random(2)
    edges = [(f"v{r.randrange(300)}", f"v{r.randrange(300)}") for _ in range(220)] + [("hub", f"h{i}") for i in range(150)] + [(f"c{i}", f"c{i + 1}") for i in range(60)]
    edges += edges[:9] + [("x", "x"), (None, "y"), ("y", None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[find(a)] = find(b)
    groups = defaultdict(set)
    for v in list(parent):
        groups[find(v)].add(v)
    want = {v: min(g) for g in groups.values() for v in g}
    frame = spark.createDataFrame(edges, "a string, b string")
    assert {x.clusterId: x.groupId for x in components.group_ids(frame).collect()} == want
    assert components.group_ids(frame.limit(0)).count() == 0


def test_decision_links(spark):
    d = spark.createDataFrame([("cluster_pair", "same_event", " B | a"), ("cluster_pair", "same_event", "a|a"), ("cluster_pair", "same_event", None),
                               ("cluster_pair", "unrelated", "c|d"), ("item_cluster", "same_event", "e|f"), ("cluster_pair", "same_event", "odd")], "kind string, relation string, pairKey string")
    c = spark.createDataFrame([("b", "c", 0.9), ("x", "y", 0.89), ("p", None, 0.99), ("q", "r", None)], "leftClusterId string, rightClusterId string, vectorSimilarity double")
    got = {x.clusterId: x.groupId for x in components.group_ids(components.decision_links(d, c)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}


def grams(t):
    t = " ".join((t or "").lower().split())
    return {t[i : i + 3] for i in range(len(t) - 2)}


@pytest.mark.parametrize("hot", [near_dup.HOT, 20])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dup, "HOT", hot)
    r, rows = random.Random(3), [("items", None, "abc"), ("items", "n", None), ("items", "e", ""), ("items", "s", "ab"), ("items", "t1", "aaaa"), ("items", "t2", "aaaaa"), ("clusters", "t3", "aaaaa")]
    words = ["".join(r.choice("abcdeéü日本") for _ in range(r.randrange(2, 7))) for _ in range(60)]
    for i in range(160):
        base = [r.choice(words) for _ in range(r.randrange(2, 12))]
        rows.append(("items" if i % 3 else "clusters", f"b{i}", " ".join(base)))
        for k in range(r.randrange(3)):
            edit = list(base)
            edit[r.randrange(len(edit))] = r.choice(words)
            rows.append((rows[-1][0] if k else "items", f"b{i}_{k}", ("  " if k else "").join([" ".join(edit).upper()])))
    rows += [("items", "long1", "lorem ipsum " * 3000 + "x1"), ("items", "long2", "lorem ipsum " * 3000 + "x2")] + [("items", f"copy{i}", " Same  Text here ") for i in range(6)]
    rows += rows[5:30]
    want = set()
    known = sorted({(t, i, s) for t, i, s in rows if i and s}, key=lambda x: x[:2])
    sets = [grams(s) for _, _, s in known]
    for a in range(len(known)):
        for b in range(a + 1, len(known)):
            if known[a][0] == known[b][0] and sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                want.add((known[a][0], known[a][1], known[b][1]))
    frame = spark.createDataFrame([(*x, 1) for x in rows], "tableName string, id string, text string, rid int")
    got = [tuple(x) for x in near_dup.near_duplicate_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    linked = {x.id for x in near_dup.near_duplicate_groups(frame).collect()}
    assert linked == {i for _, *ids in want for i in ids}
    assert near_dup.near_duplicate_pairs(frame.limit(0)).count() == 0


def test_plain_forms(spark):
    cases = {
        "Ｗｉｌｌｉａｍ Ｂｒｕｄｒｅｓｔｏúｍ": "William Brudrestoúm", "Stеһeivil brіdgе": "Stеһeivil brіdgе".translate(str.maketrans("еһі", "ehi")), "a​b­c": "abc",
        "café": "café", "ﬂow‑er": "flow-er", "KlozhiadreK": "KlozhiadreK".replace("eK", "eK"), "ｶﾞ": "ガ",
    }
    same = ["Житекярофов Завод", "Σπσπψαξισπ", "荻渊堃骁重工", "Bråsiberk Café", "plain", "", None, "x" * 50_000]
    rows = [("f", str(i), v, "clash") for i, v in enumerate([*cases, *same, *cases])]
    frame = spark.createDataFrame(rows, "field string, rowId string, value string, plain string")
    got = {(x.rowId, x.value): x.plain for x in lookalike.find_odd(frame).collect()}
    assert {v: p for (_, v), p in got.items()} == cases and len(got) == 2 * len(cases)
    assert lookalike.find_odd(frame.limit(0)).count() == 0


def test_vocabulary_decides_script(spark):
    rows = [("f", "1", "рос"), ("f", "2", "poс"), ("f", "3", "рoс")]  # the known word is Cyrillic
    assert {x.rowId: x.plain for x in lookalike.find_odd(spark.createDataFrame(rows, "field string, rowId string, value string")).collect()} == {"2": "рос", "3": "рос"}


SAMPLES = {
    "en": "the council said that it would not pay for the repair of the line", "de": "der Rat sagte dass er die Reparatur der Strecke nicht bezahlen werde",
    "fr": "le conseil a dit que la ville ne paierait pas la réparation de la ligne", "es": "el consejo dijo que no pagaría la reparación de la línea",
    "pt": "o conselho disse que não pagaria a reparação da linha", "zh": "委员会表示不会支付线路的维修费用", "ja": "評議会は路線の修理費を払わないと述べた",
}


def test_languages(spark):
    samples = spark.createDataFrame([(i, l, s) for i, (l, s) in enumerate([*SAMPLES.items()] * 4)], "sample_id int, lang string, sample string")
    rows = [(f"i{l}", s, None, l) for l, s in SAMPLES.items()] + [("wrong", SAMPLES["de"], SAMPLES["zh"], "en-US"), ("missing", SAMPLES["fr"], None, "und"), ("code", SAMPLES["pt"], SAMPLES["pt"], "por")]
    rows += [("mixed", SAMPLES["en"] + " | " + SAMPLES["ja"], "", "en"), ("empty", "", None, None), ("null", None, None, None), ("long", SAMPLES["es"] * 500, None, "es"), rows[0]]
    items = spark.createDataFrame(rows, "id string, originalTitle string, translatedTitle string, language string")
    got = {(x.itemId, x.field, x.lang) for x in language.wrong_languages(language.judge_items(items, samples)).collect()}
    o, t = "originalTitle", "translatedTitle"
    assert got == {("wrong", o, "de"), ("missing", o, "fr"), ("code", t, "pt"), ("mixed", o, "en"), ("mixed", o, "ja")}
    assert language.judge_items(items.limit(0), samples).count() == 0


def test_names(spark):
    e = [("e1", "Benjamin Defoques"), ("e2", "Wuskegrath Matthew"), ("e3", "Defleisteil 2"), ("e4", "Defleisteil 3"), ("e5", "Trouhatil Motors"), ("e6", "Trouhatil Technologies PLC"),
         ("e7", "University of Priflópriam"), ("e8", "Boflirîath Institute of Polar Research"), ("e9", "荻渊堃骁重工"), ("e10", None), ("e11", "Klîgajoth Bank"), ("e1", "Benjamin Defoques")]
    a = [("a1", None, "Dr. Ben Defoqeus"), ("a2", None, "Matt Wuskegrath PhD"), ("a3", None, "Defleisetil II"), ("a4", None, "TROUHATIL MOTORS CORP."), ("a5", None, "Priflopriam Uni"), ("a6", None, "BIoPR-BOF"),
         ("a7", None, "荻渊堃骁重工集团"), ("a8", "e11", "Something Else"), ("a9", None, ""), ("a10", None, "Defоques, B."), ("a11", None, "x" * 3000)]
    ef = spark.createDataFrame([(i, n, None) for i, n in e], "id string, name string, normalized string")
    af = spark.createDataFrame([(i, x, n, None) for i, x, n in a], "id string, entityId string, aliasName string, aliasNormalized string")
    got = {(x.keyA, x.keyB) for x in names.variant_pairs(ef, af).collect()}
    want = {("a1", "e1"), ("a10", "e1"), ("a1", "a10"), ("a2", "e2"), ("a3", "e3"), ("a4", "e5"), ("a5", "e7"), ("a6", "e8"), ("a7", "e9"), ("a8", "e11")}
    assert got == want
    assert names.variant_pairs(ef.limit(0), af.limit(0)).count() == 0


def test_names_link_two_edits_in_small_tables(spark):
    rows = [("a", "Quaquiaketh Mining"), ("b", "Quaquiskith Mining"), ("c", "Quaquiaketh Bank"), ("d", "Quaquiskoth Mining Ltd"), ("e", "Goriam Studios"), ("f", "Gatoriam Studios")]
    rows += [(f"n{i}", f"{w} Mining") for i, w in enumerate(("Quaquazol", "Skithemor", "Laketharn", "Uiakondra", "Viskidel", "Tuiskabor", "Braketho"))]
    got = names.link_names(spark.createDataFrame(rows, "key string, name string"), spark.createDataFrame([], "a string, b string")).collect()
    assert {(x.key, x.groupId) for x in got} == {("a", "a"), ("b", "a"), ("d", "a"), ("e", "e"), ("f", "e")}


def test_radius_join_is_exact(spark):
    r = random.Random(5)
    words = list({"".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(400)})
    frame = spark.createDataFrame([(str(len(w) % 1), w) for w in words] + [("0", None), ("0", "")], "space string, name string")
    got = {(x.a, x.b, x.d) for x in names.radius_join(frame).collect()}
    want = {(min(x, y), max(x, y), d) for i, x in enumerate(words) for y in words[i + 1 :] if (d := names.edits(x, y, 2)) <= 2}
    assert got == want


def test_packing(spark):
    r = random.Random(4)
    sizes = [(i, r.choice([0, None, 1, 2048, 2049, 7000, 300, r.randrange(1, 900)])) for i in range(600)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_ids int")).collect()
    total, boxes = defaultdict(int), defaultdict(int)
    for x in got:
        total[x.doc_id] += x.length
        assert (x.container is None) == (x.length == 0)
        if x.container is not None:
            boxes[x.container] += x.length
    assert dict(total) == {i: n or 0 for i, n in sizes} and max(boxes.values()) <= 2048
    assert all(sum(1 for x in got if x.doc_id == i) == 1 for i, n in sizes if (n or 0) <= 2048)
    assert sum(boxes.values()) > 0.98 * 2048 * len(boxes)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_ids int")).count() == 0


def test_best_two_fit_replaces():
    box = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)  # 6 + 3 leaves 1; 3 gives way to 2 + 2
    assert box[0] == box[2] == box[3] != box[1]


GOOD = ["“We’re not done yet,” said Chloé — the café’s owner.", "第二份报告将于9月12日公布，重点审查公司的作用。", "彼は記者団に語り、計画は決まっていない。", "Zażółć", "Некипорадям Завод"]


def test_garbled(spark):
    rows, bad = [(i, g) for i, g in enumerate(GOOD)] + [(50, None), (51, ""), (52, "plain ascii"), (53, "é" * 20_000)], {}
    for k, e in enumerate(("cp1252", "latin-1", "cp1251", "mac_roman")):
        table = {b: c for c, b in garble.BYTES[e].items()}
        for j, g in enumerate(GOOD[:3]):
            shown = "".join(table[b] if b > 127 else chr(b) for b in g.encode())
            bad[100 + 10 * k + j] = (f"Fine first line.\n{shown}\n", f"Fine first line.\n{g}\n")
    bad[200] = (GOOD[0].encode().decode("cp1252", "replace").encode().decode("cp1252", "replace"), None)  # twice
    bad[201] = ("An anunci� el plan", None)
    bad[202] = (GOOD[1].encode().decode("gb18030", "replace"), None)
    frame = spark.createDataFrame(rows + [(k, x) for k, (x, _) in bad.items()], "doc_id long, text string")
    got = {x.doc_id: x for x in garble.find_garbled(frame).collect()}
    assert set(got) == set(bad)
    for k, (_, want) in bad.items():
        if want:
            assert got[k].text == want and got[k].restored
    assert not got[201].restored
    assert garble.find_garbled(frame.limit(0)).count() == 0


def test_damerau_is_a_true_metric_and_vectorised_alike():
    r = random.Random(8)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(0, 6))) for _ in range(60)]
    assert names.edits("ca", "abc", 5) == 2
    d = {(x, y): names.edits(x, y, 9) for x in words for y in words}
    assert all(d[x, y] == d[y, x] and (d[x, y] == 0) == (x == y) for x in words for y in words)
    assert all(d[x, z] <= d[x, y] + d[y, z] for x in words[:25] for y in words[:25] for z in words[:25])
    pairs = [(x, y) for x in words for y in words]
    assert names.edit_distances([x for x, _ in pairs], [y for _, y in pairs], 2).tolist() == [min(d[p], 3) for p in pairs]


def test_radius_join_of_long_names(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefghijklmnop") for _ in range(n)) for n in (38, 40, 41, 42, 43, 60, 3000)]
    words = {*base}
    for w in base:
        for _ in range(6):
            x = list(w)
            for _ in range(r.randrange(1, 3)):
                k = r.randrange(len(x) - 1)
                x[k : k + 2] = r.choice([x[k : k + 2][::-1], x[k : k + 1], [*x[k : k + 2], "z"], ["y", x[k + 1]]])
            words.add("".join(x))
    words = sorted(words)
    got = {(x.a, x.b) for x in names.radius_join(spark.createDataFrame([("s", w) for w in words], "space string, name string")).collect()}
    close = lambda x, y: abs(len(x) - len(y)) <= 2 and len(x) < 100 and names.edits(x, y, 2) <= 2
    assert {p for p in got if len(p[0]) < 100} == {(x, y) for i, x in enumerate(words) for y in words[i + 1 :] if close(x, y)}
    assert sum(len(p[0]) > 100 for p in got) >= 6


def test_copies_of_two_spellings_are_linked(spark):
    brands = ("Trouhatil", "Skimmorad", "Fleiquand", "Wodrezhop", "Jiapuklom")
    times = dict(zip(brands, (1, 2, 3, 7, 50)))
    rows = [(f"{b}{side}{i}", w + " Motors") for b, n in times.items() for side, w in enumerate((b, b[:-2] + b[-1] + b[-2])) for i in range(n)]
    got = names.link_names(spark.createDataFrame(rows, "key string, name string"), spark.createDataFrame([], "a string, b string")).collect()
    assert len(got) == len(rows) and {x.groupId: sum(y.groupId == x.groupId for y in got) for x in got} == {f"{b}00": 2 * n for b, n in times.items()}


def test_lines_of_business_come_from_the_corpus(spark):
    brands = ["Quaquazol", "Skithemor", "Laketharn", "Uiakondra", "Viskidel", "Tuiskabor"]
    rows = [(f"{b}{i}", f"{b} {t}") for b in brands for i, t in enumerate(("Zemmuring", "Zmrg", "Fish Ponds"))] + [("p1", "Laketharn Viskidel Zmrg"), ("p2", "Viskidel-Laketharn Zemmuring")]
    lines = names.lines_of_business(spark.createDataFrame(rows, "key string, name string"))
    assert lines.ends == {"zemmuring", "ponds", "fish ponds"} and lines.short == {"zmrg": "zemmuring"}
    assert names.parse("Laketharn Viskidel Zmrg", lines) == names.parse("Viskidel-Laketharn Zemmuring", lines) == ("pair", "laketharn viskidel", "zemmuring")


def test_recall_of_names_without_known_links(spark):
    """Aliases of known entities are grouped with them when entityId is withheld."""
    e, a = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("entities", "aliases"))
    rows = e.selectExpr("id as key", "name").unionByName(a.selectExpr("id as key", "aliasName as name"))
    of = {x.key: x.groupId for x in names.link_names(rows, spark.createDataFrame([], "a string, b string")).collect()}
    known = [(x.id, x.entityId) for x in a.filter("entityId is not null").collect()]
    assert sum(of.get(x, x) == of.get(y, y) for x, y in known) >= 0.9 * len(known)


def test_pairs_of_a_large_group(spark):
    from loomline.runtime import pairs_within

    rows = [("big", i) for i in range(90)] + [("small", i) for i in range(3)] + [("one", 1), (None, 2), ("n", None)]
    got = pairs_within(spark.createDataFrame(rows, "g string, k int"), "g", "k", chunk=10)
    assert got.count() == got.distinct().count() == 90 * 89 // 2 + 3


def _model():
    texts = [(l, s) for l, s in SAMPLES.items() for _ in range(4)]
    return language.Model(texts, texts)


def test_centroids_decide_languages():
    model = _model()
    right = [model.judge([s])[0] for s in SAMPLES.values()]
    assert [[p[0] for p in ps] for ps in right] == [[l] for l in SAMPLES]
    model.centroids = np.roll(model.centroids, language.CENTROIDS, axis=1)  # each language gets its neighbour's
    model.memo.clear()
    assert not any([p[0] for p in ps] == [l] for l, ps in zip(SAMPLES, (model.judge([s])[0] for s in SAMPLES.values())))


def test_distance_rejects_gibberish_and_short_parts_need_clean_words():
    model = _model()
    assert model.judge(["xqzt vbnmw qqpf ztrrx wkkj qwxz", "Skibod Trouhat Zemmuring", "🙂 !!"]) == [[], [], []]
    assert [p[0] for p in model.judge([SAMPLES["zh"] + " | council repair"])[0]] == ["zh", "en"]
    assert [p[0] for p in model.judge([SAMPLES["zh"] + " | Zemmu Skibod"])[0]] == ["zh"]


def test_garbling_of_any_depth_and_short_runs(spark):
    plain = "Der Rat prüft die Brücke über den Fluß: „größer“ hieß es. 会议将在下周举行。"
    rows, text = [(0, plain)], plain
    for k in range(1, 6):
        text = text.encode("utf-8").decode("latin-1")
        rows.append((k, text))
    rows += [(10, "Herr &Atilde;&frac14;ber sagte, der Flu&Atilde;&Yuml; steigt"), (11, "Fish &amp; chips"), (12, "Ein Café, naïve Häuser «für» “Öl”")]
    rows += [(20 + k, "会议将在下周举行。公司" * 9) for k in range(9)] + [(13, "Mr " + "公司".encode("gbk").decode("latin-1") + " spoke")]
    got = {x.doc_id: x for x in garble.find_garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 10, 13} and got[13].text == "Mr 公司 spoke"
    assert all(got[k].text == plain for k in range(1, 6)) and got[10].text == "Herr über sagte, der Fluß steigt"


def test_lookalikes_of_more_scripts_and_whole_words(spark):
    rows = [("f", "1", "Hօuse Սnion"), ("f", "2", "ᎪᎡt ﬁne Ⅳ"), ("f", "3", "𝐁ank"), ("f", "4", "Առավոտ"), ("f", "5", "Ꮳꮃꮒ"), ("f", "6", "pаn pаnama"), ("f", "7", "…№ ½")]
    got = {x.rowId: x.plain for x in lookalike.find_odd(spark.createDataFrame(rows, "field string, rowId string, value string")).collect()}
    assert got == {"1": "House Union", "2": "ARt fine IV", "3": "Bank", "6": "pan panama"}


def test_near_duplicates_in_rounds(spark, monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choice("red green blue one two three".split()) + str(r.randrange(30)) for _ in range(8)) for _ in range(150)]
    frame = spark.createDataFrame([("t", f"{k}{x}", v + x) for k, v in enumerate(texts) for x in ("", "!")], "tableName string, id string, text string")
    want = {tuple(x) for x in near_dup.near_duplicate_pairs(frame).collect()}
    monkeypatch.setattr(near_dup, "PART_BYTES", 3_000)
    monkeypatch.setattr(near_dup, "ROUND", 2)
    seen = []
    monkeypatch.setattr(near_dup, "plan", lambda *x, real=near_dup.plan: seen.append(real(*x)) or seen[-1])
    assert {tuple(x) for x in near_dup.near_duplicate_pairs(frame).collect()} == want and len(want) >= 150
    assert seen[0][0] > 4 and seen[0][1] > 1


@pytest.mark.parametrize("times", [1, 10, 50, 1000])
def test_what_a_round_routes_does_not_grow_with_the_parts(times):
    texts, keys, tokens = 371_000 * times, 71 * 371_000 * times, 60_000_000 * times
    parts, rounds = near_dup.plan(texts, keys, tokens, 6)
    touched = parts * -math.expm1(-71 / parts)
    assert texts * (76 * touched + 8 * 71) / rounds <= near_dup.ROUND * tokens
    assert texts * (76 * touched + 8 * 71) / parts <= near_dup.PART_BYTES * 1.01
    assert rounds <= max(6, -(-71 * 84 * 371_000 // (near_dup.ROUND * 60_000_000)))
