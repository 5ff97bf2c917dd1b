"""Operators for training data: brute force, round trips, nulls, empty tables, ties and repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import p01_scans, p02_markup, p03_canonical, p04_frequency, p05_distinctive, p06_lookalikes, p07_split, p08_leakage, p09_mixing, p10_repetition
from clausemill.llm.markup_text import plain_of, text_of

SENTENCES = ["在模板安装开始前应设置检修通道。", "构造柱应采用双面满焊连接。", "运输途中应采取防倾覆措施。", "夜间应开启红色示警灯。"]


def scans(spark, texts, table="read_clause_full"):
    return spark.createDataFrame([(table, k, t, ["GBT72261", "GB/T 72261-2011"], ["冷藏库围护材料试验方法标准"]) for k, t in enumerate(texts)], "src_table string, row_id bigint, text string, codes array<string>, names array<string>")


def test_p1_repairs_clauses(spark):
    good = SENTENCES * 10
    bad = ["构造柱应采用双面满悍连接。", "运输途中应采取\n– 66 –\nGB/T 72261-2011\n防倾覆措施。", "夜间应开启红色示警灯。\n冷 藏 库 围 护 材 料 试 验 方 法 标 准  12", "夜间应开启红-\n色示警灯。", "在模板安装\n开始前应设置检修通道。"]
    got = {r.row_id: r for r in p01_scans.repair(scans(spark, good + bad)).collect()}
    n = len(good)
    assert all(not got[k].kinds and got[k].text == good[k] for k in range(n))
    assert (got[n].text, got[n].kinds) == (SENTENCES[1], ["misread"])
    assert (got[n + 1].text, got[n + 1].kinds) == (SENTENCES[2], ["broken_line", "page_number", "running_header"])
    assert (got[n + 2].text, got[n + 2].kinds) == (SENTENCES[3], ["page_number", "running_header"])
    assert (got[n + 3].text, got[n + 3].kinds) == (SENTENCES[3], ["broken_line"])
    assert got[n + 4].text == SENTENCES[0]


def test_p1_headings_and_empty(spark):
    got = p01_scans.repair(scans(spark, ["5.2 钢筋绑扎 GB/T 72261-2011 冷藏库围护材料试验方法标准 189", "4.1 洞口栏杆验收表 8", "3 质量验收  41", "3.I 屋面"], "kb_search_index"))
    assert {r.row_id: (r.text, sorted(r.kinds)) for r in got.collect()} == {0: ("5.2 钢筋绑扎", ["page_number", "running_header"]), 1: ("4.1 洞口栏杆验收表 8", []), 2: ("3 质量验收", ["page_number"]), 3: ("3.1 屋面", ["misread"])}
    assert p01_scans.repair(scans(spark, [])).count() == 0


def test_p1_corrects_pairs_outside_the_table(spark):
    """A character that no table pairs with the printed one is corrected where its whole context is certain, else left."""
    texts = SENTENCES * 20 + ["夜间应开启红色示誓灯。", "夜间应开启绿色示警灯。"] + ["绿色建筑应节约用水。"] * 5
    got = {r.row_id: (r.text, r.kinds) for r in p01_scans.repair(scans(spark, texts)).collect()}
    assert "誓" not in p01_scans.PRINTED and got[80] == (SENTENCES[3], ["misread"])
    assert got[81] == (texts[81], []), "a word that is rare here but made of known characters stays"


def test_p1_learns_english_headers(spark):
    """Names that begin like many lone lines are headers; beginnings of sentences are not, also where a line is torn."""
    lines = ["Drains shall be flushed weekly.", "All joints shall be sealed on both sides."]
    whole = [" ".join(lines)] * 10
    torn = [f"All joints shall be\nStandard for sealing of {x} {k + 3}\nsealed on both sides." for k, x in enumerate(("tunnels", "bridges", "towers", "dams", "locks"))]
    got = {r.row_id: (r.text, r.kinds) for r in p01_scans.repair(scans(spark, whole + torn + ["All joints shall be\nsealed on both sides."])).collect()}
    for k in range(len(torn)):
        assert got[10 + k] == (lines[1], ["broken_line", "page_number", "running_header"])
    assert got[15] == (lines[1], ["broken_line"]) and got[0] == (whole[0], [])


def test_p1_keeps_every_entry_of_a_large_vocabulary(spark):
    """Over a million other triples, more frequent than the one that is needed, don't push it out or raise the least count."""
    draw = random.Random(2)
    large = ["".join(chr(draw.randrange(0x4E00, 0x9E00)) for _ in range(50_000)) for _ in range(22)]
    key, _ = p01_scans.triples_of(large)
    assert len(np.unique(key)) > 1_050_000
    texts = [SENTENCES[1]] * 4 + ["构造柱应采用双面满悍连接。"] + large * 5
    got = {r.row_id: (r.text, r.kinds) for r in p01_scans.repair(scans(spark, texts)).filter("row_id < 5").collect()}
    assert got[4] == (SENTENCES[1], ["misread"]) and got[0] == (SENTENCES[1], [])


def test_p1_keeps_every_opener(spark):
    """The rarest of more than 10,000 openers still tells a header."""
    letters = "abcdefghij"
    names = ["Rules " + "".join(letters[k // 10**p % 10] for p in range(5)) for k in range(10_050)]
    many = "\n".join(f"All is done.\n{name} for sealing of joints" for name in names) + "\nAll is done."
    texts = [many] * 5 + ["All is done.\nZoning plans for sealing of joints\nAll is done."] * 4
    got = p01_scans.repair(scans(spark, texts)).filter("row_id >= 5").collect()
    assert {(r.text, tuple(r.kinds)) for r in got} == {("All is done.\nAll is done.", ("running_header",))} and len(got) == 4


@pytest.mark.parametrize("part", [1_000_000, 20])
def test_p1_table_finds_what_was_stored(spark, monkeypatch, part):
    """Entries of a stored table, of one part or several, against the plain list: triples, words of a shape, openers, and none."""
    monkeypatch.setattr(p01_scans, "PART_ENTRIES", part)
    draw = random.Random(3)
    triples = {"".join(draw.choices("|甲乙丙丁0", k=1) + draw.choices("甲乙丙丁", k=1) + draw.choices("|甲乙丙丁0", k=1)): draw.randint(4, 99) for _ in range(60)}
    words = {"".join(draw.choices("rnmcld01oé", k=draw.randint(1, 5))): draw.randint(4, 99) for _ in range(200)}
    words = {w: n for w, n in words.items() if not w.isdigit()}
    tokens = [*triples.items(), *words.items(), ("^all joints", 5), ("^some drains", 4)]
    for entries in (tokens, tokens[:1], tokens[-1:], []):
        name, signs = p01_scans.stored(spark.createDataFrame(entries, "token string, n bigint").repartition(3))
        table, want = p01_scans.Table(name), dict(entries)
        reader, openers = p01_scans.Reader(table, 4, signs), p01_scans.Openers(table)
        assert set(signs) == {t[1] for t in want if t in triples}
        assert all(table.count(a + b + c) == want.get(a + b + c, 0) for a in "|甲戊0" for b in "甲乙戊" for c in "|甲戊0")
        for a, c in ("甲乙", "|甲", "戊甲"):
            near, counts = table.around(a + c)
            assert dict(zip(map(chr, near.tolist()), counts.tolist())) == {t[1]: n for t, n in want.items() if t in triples and t[0] + t[2] == a + c}
        assert all(reader.word_count(w) == want.get(w, 0) for w in [*words, "none"])
        assert [o in openers for o in ("all joints", "some drains", "none here")] == ["^all joints" in want, "^some drains" in want, False]
        assert bool(openers) == ("^some drains" in want)


def test_p1_triples_of_batches():
    texts = ["甲乙丙", "", "第12.5节a", "丁\n戊", "甲乙丙"]
    key, owner = p01_scans.triples_of(texts)
    got = sorted(zip(owner.tolist(), map(p01_scans.triple_text, key.tolist())))
    assert got == sorted([(0, "|甲乙"), (0, "甲乙丙"), (0, "乙丙|"), (2, "|第0"), (2, "第0节"), (2, "0节|"), (3, "|丁|"), (3, "|戊|"), (4, "|甲乙"), (4, "甲乙丙"), (4, "乙丙|")])


def test_p1_automaton_finds_all():
    random.seed(1)
    words = {"".join(random.choices("abc", k=random.randint(1, 5))): 1 for _ in range(150)}
    for probe in random.sample(sorted(words), 20):
        found = {w for w, _ in p01_scans.Trie(words).within(probe, 2)}
        assert found == {w for w in words if levenshtein(w, probe) <= 2}


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("text, plain, kinds", [
    ("<h3>注浆</h3>应<strong>不</strong>大于5m<sup>2</sup>。", "注浆\n应不大于5m²。", ["html"]),
    ("## 3.4.5 爆破\n- 甲。\n```\nL = 2 * b\n```", "3.4.5 爆破\n• 甲。\n    L = 2 * b", ["markdown"]),
    ("== 抹灰 ==\n见[[附录#表1|附表]]。{{注|甲}}", "抹灰\n见附表。（甲）", ["wiki"]),
    ("不大于$5\\mathrm{m}$。\\cite{a1}", "不大于5m。[a1]", ["latex"]),
    ("{| class=\"wikitable\"\n|-\n! 项目 !! 值\n|-\n| 甲 || 4\n|}", "项目\t值\n甲\t4", ["wiki"]),
    ("w<15%且h>3.5m，按2*7排，3#楼，文献[4]，GB_T风格", None, []), ("- 129 -", None, []), ("", None, []),
])
def test_p2_markup(text, plain, kinds):
    assert p02_markup.clean_markup(text) == (text if plain is None else plain, kinds)


def test_p2_null_and_long():
    assert p02_markup.clean_markup(None) == (None, [])
    assert p02_markup.clean_markup("<div>" * 200 + "甲" * 100_000)[0] == "甲" * 100_000


@pytest.mark.parametrize("depth", [5_000, 100_000])
def test_p2_hostile_nesting(depth):
    import time

    for text in ("<div>" * depth + "甲" * 1000, "<b>" * depth + "甲", "<div>" * depth + "</p>" * depth, "<a><div>" * depth + "甲" + "</div></a>" * depth):
        began = time.process_time()
        plain, kinds = p02_markup.clean_markup(text)
        assert kinds == ["html"] and set(plain) <= {"甲"} and time.process_time() - began < 20
    assert p02_markup.clean_markup("\ue0000\ue001" + "\\[" * 10_000)[0].startswith("0")


def test_p2_link_blocks_are_judged_by_score():
    links = "<ul>" + "".join(f"<li><a href='{k}'>目录第{k}项</a></li>" for k in range(9)) + "</ul>"
    body = "<div><p>" + "基坑开挖前应编制方案，报监理审批，并按方案施工。" * 4 + "</p></div>"
    assert "目录" not in p02_markup.clean_markup(f"<body>{links}{body}</body>")[0]
    assert "目录" in p02_markup.clean_markup(links)[0], "a list of links alone is the best there is"
    assert "说明" in p02_markup.clean_markup(f"<body><p>说明</p>{body}</body>")[0]


def test_p3_mapping(spark):
    entries = spark.createDataFrame([("GBT72261", "冷藏库围护材料试验方法标准"), ("JGJ4226", "山岭公路隧道质量验收统一规程"), ("JGJ4926", None)], "standard_code string, standard_name string")
    values = {"ＧＢ／Ｔ７２２６１": "GBT72261", "GB 72261-2011": "GBT72261", "GB/T 7226l": "GBT72261", "JGJ 4262": "JGJ4226", "《冷藏库围护材料式验方法标准》": "GBT72261", "JGJ 4826": "UNMATCHED", "GB 301720": "UNMATCHED", "图集": "UNMATCHED", "4226": "JGJ4226", "冷藏库围护材料试验方法标准（试行）": "GBT72261"}
    rows = spark.createDataFrame([(v,) for v in values] * 2 + [(None,), (" ",)], "value string")
    assert {r.value: r.standard_code for r in p03_canonical.map_to_list(rows, entries).collect()} == values
    assert p03_canonical.map_to_list(rows.limit(0), entries).count() == 0


def test_p3_index_is_complete():
    """Every number one slip away and every name two changes away shares a gram with its entry."""
    random.seed(9)
    for _ in range(300):
        number = "".join(random.choices("0123456789", k=random.randint(3, 6)))
        k = random.randrange(len(number))
        for typed in (number[:k] + random.choice("0123456789") + number[k + 1 :], number[:k] + number[k + 1 :], number[:k] + "7" + number[k:], number[:k] + number[k : k + 2][::-1] + number[k + 2 :]):
            assert set(p03_canonical.number_grams(typed)) & set(p03_canonical.number_grams(number))
            assert p03_canonical.slips(typed, number, 1) <= 1
        name = list(random.choices("甲乙丙丁戊己庚辛", k=random.randint(4, 15)))
        parts = p03_canonical.thirds("".join(name))
        for _ in range(2):
            at = random.randrange(len(name))
            random.choice((lambda: name.__setitem__(at, "变"), lambda: name.insert(at, "加"), lambda: name.pop(at)))()
        assert any(part in "".join(name) for part in parts)


def test_p3_postings_do_not_grow_with_the_list():
    """Index entries that a typed number meets in lists of growing size."""
    random.seed(10)
    met = []
    for size in (1000, 10_000):
        numbers = random.sample(range(10_000_000, 100_000_000), size)
        index = {}
        for n in map(str, numbers):
            for gram in p03_canonical.number_grams(n):
                index.setdefault(gram, set()).add(n)
        met.append(max(len({n for g in p03_canonical.number_grams(str(x)) for n in index.get(g, ())}) for x in numbers[:200]))
    assert max(met) < 20


def test_p3_equals_all_pairs(spark):
    """Mapping by the index gives what scoring every value against every entry gives."""
    random.seed(11)
    subjects, kinds = ["冷藏库围护", "山岭公路隧道", "污水深井泵站", "顶管穿越段"], ["材料试验方法标准", "质量验收统一规程", "变形监测技术规范"]
    entries = [(f"{random.choice(['GBT', 'GB', 'JGJ', 'DB91T'])}{random.randint(4000, 4400)}", s + k) for s in subjects for k in kinds]

    def slip(text):
        k = random.randrange(len(text))
        return random.choice((text, text[:k] + random.choice("0123式工") + text[k + 1 :], text[:k] + text[k + 1 :], text[:k] + text[k : k + 2][::-1] + text[k + 2 :], text + "（试行）", "按" + text + "执行"))

    values = sorted({slip(random.choice((c, n, c + "-2011", c + " " + n))) for c, n in entries * 25})
    frame = spark.createDataFrame(entries, "standard_code string, standard_name string")
    got = {r.value: r.standard_code for r in p03_canonical.map_to_list(spark.createDataFrame([(v,) for v in values], "value string"), frame).collect()}
    weights = np.full(p03_canonical.SLOTS, np.log(1 + len(entries)), np.float32)
    slots = [p03_canonical.slot(g) for _, n in entries for g in p03_canonical.name_grams(n)]
    for k in set(slots):
        weights[k] = np.log(1 + len(entries) / slots.count(k))
    scorer = p03_canonical.Scorer(weights)
    families = [p03_canonical.family_of(c) for c, _ in entries]
    pattern = p03_canonical.code_pattern([f for f, _ in families])
    for v in values:
        family, number, name = p03_canonical.parse_value(v, pattern)
        found = []
        for (code, listed), (own, digits) in zip(entries, families):
            usable = number if not family or family == own else None
            if p03_canonical.holds(usable, name, digits, listed):
                found.append((scorer.cosine(number, name, digits, listed), code))
        found.sort(reverse=True)
        clear = found and found[0][0] >= p03_canonical.LEAST and (len(found) < 2 or found[0][0] - found[1][0] >= p03_canonical.MARGIN)
        if len({c for _, c in found}) == len(found):
            assert got[v] == (found[0][1] if clear else "UNMATCHED"), v


def test_p7_cuts_are_the_cheapest():
    """The dynamic programme against the same recurrence over all pairs, without vectors."""
    random.seed(12)
    for _ in range(30):
        text = "".join(random.choices("甲乙丙丁。，；\n ", weights=[9, 9, 9, 9, 2, 3, 1, 1, 1], k=random.randint(120, 400)))
        most, overlap = 100, 20
        at, cost = p07_split.boundaries(text)
        begin = [int(at[k]) if not k else min(((cost[j], j) for j in range(k) if at[j] >= at[k] - overlap), default=(0, k))[1] for k in range(len(at))]
        begin = [0] + [int(at[j]) for j in begin[1:]]
        even = len(text) / np.ceil(len(text) / (most - overlap))
        best = [0.0] + [np.inf] * (len(at) - 1)
        for k in range(1, len(at)):
            best[k] = min((best[j] + p07_split.BALANCE * ((at[k] - at[j] - even) / most) ** 2 + cost[k] for j in range(k) if at[k] - begin[j] <= most), default=np.inf)
        pieces = p07_split.split_text(text, most, overlap)
        ends = [0] + [e for _, e, _ in pieces]
        index = {int(p): k for k, p in enumerate(at)}
        total = sum(p07_split.BALANCE * ((b - a - even) / most) ** 2 + cost[index[b]] for a, b in zip(ends, ends[1:]))
        assert total == pytest.approx(best[-1])


def test_p4_runs(spark):
    random.seed(2)
    pairs = [("q", random.choice("abcde"), random.randint(1, 30), random.randint(0, 9)) for _ in range(3000)] + [("c", "hot", k % 40, k) for k in range(2000)] + [("q", None, 1, 0)]
    got = {(r.field, r.term): (r.occurrences, r.records) for r in p04_frequency.term_frequencies(spark.createDataFrame(pairs, "field string, term string, record bigint, place int").repartition(7)).collect()}
    want = {}
    for f, t, r, p in pairs:
        if t is not None:
            want.setdefault((f, t), set()).add((r, p))
    assert got == {k: (len(v), len({r for r, _ in v})) for k, v in want.items()}
    assert p04_frequency.term_frequencies(spark.createDataFrame(pairs[:0], "field string, term string, record bigint, place int")).count() == 0


def test_p4_scan_across_batches():
    import pyarrow as pa

    rows = sorted([("q", "a", 1, 0), ("q", "a", 1, 0), ("q", "a", 1, 1), ("q", "a", 2, 0), ("q", "b", 2, 0), ("q", "b", None, 0), ("c", "a", 1, 0)], key=repr)
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("field", "term", "record", "place"), r)) for r in rows[k : k + size]], schema=pa.schema([("field", pa.string()), ("term", pa.string()), ("record", pa.int64()), ("place", pa.int32())])) for k in range(0, len(rows), size)]
        total = {}
        for out in p04_frequency.scan_runs(iter(batches)):
            for r in out.to_pylist():
                a, b = total.get((r["field"], r["term"]), (0, 0))
                total[r["field"], r["term"]] = a + r["occurrences"], b + r["records"]
        assert total == {("q", "a"): (3, 2), ("q", "b"): (2, 2), ("c", "a"): (1, 1)}, size


def test_p4_terms(spark):
    rows = spark.createDataFrame([(" A　b A ", [" x1", None, "", "X1"]), (None, None)], "q string, c array<string>")
    got = rows.select(p04_frequency.split_terms(F.col("q")).alias("q"), p04_frequency.trimmed_codes(F.col("c")).alias("c")).collect()
    assert (got[0].q, got[0].c, got[1].q, got[1].c) == (["a", "b", "a"], ["X1", "X1"], [], [])


def test_p5_scores(spark):
    records = spark.createDataFrame([(1, "甲甲甲乙"), (1, "甲甲甲乙"), (2, "乙乙"), (3, None), (4, "")], "rec_id bigint, text string")
    terms = spark.createDataFrame([("甲",), ("乙",), ("丙",)], "term string")
    got = {(r.rec_id, r.term): r for r in p05_distinctive.distinctive_terms(records, terms).collect()}
    assert {k: (v.n, v.df, v.total_records) for k, v in got.items()} == {(1, "甲"): (3, 1, 4), (1, "乙"): (1, 2, 4), (2, "乙"): (2, 2, 4)}
    assert got[1, "甲"].z > 0 > got[1, "乙"].z
    assert p05_distinctive.distinctive_terms(records.limit(0), terms).count() == 0
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(p05_distinctive, "MOST_TERMS", 2)
        with pytest.raises(ValueError):
            p05_distinctive.distinctive_terms(records, terms)


def test_p6_forms(spark):
    texts = {1: "采用Nörvik构件", 2: "采用Nӧrvіk构件", 3: "采用Nörvik构件", 4: "ＧＢ／Ｔ７２２６１\u2009\u2f64\u200b", 5: "φ12，α=1.8，5Ω，①，Ⅱ，25℃，m²", 6: None, 7: "\uf967"}
    rows = spark.createDataFrame([("t", k, v) for k, v in texts.items()] + [("t", 2, texts[2])], "src_table string, row_id bigint, text string")
    got = {r.row_id: (r.text, r.kinds) for r in p06_lookalikes.normalise_lookalikes(rows).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == "采用Nörvik构件"
    assert (got[1][1], got[2][1], got[3][1]) == ([], ["lookalike"], ["combining"])
    assert got[4] == ("GB/T72261 用", ["invisible", "lookalike", "space", "width"])
    assert got[5] == (texts[5], []) and got[6] == (None, []) and got[7] == ("不", ["lookalike"])


def test_p7_pieces(spark):
    random.seed(3)
    for n in (0, 1, 2000, 2001, 9000):
        text = "".join(random.choices("甲乙。，\n ", k=n))
        pieces = p07_split.split_text(text)
        assert all(0 < e - s <= 2000 for s, e, _ in pieces)
        assert "".join(text[s + o : e] for s, e, o in pieces) == text and all(o <= 200 for *_, o in pieces)
    sections = spark.createDataFrame([("f", 1, 0), ("f", 1, 0), ("f", 2, 2500), ("g", 3, 0), (None, 4, 0)], "file string, section_id bigint, pos int")
    files = spark.createDataFrame([("f", "甲" * 3000), ("f", "甲" * 3000), ("g", None)], "file string, text string")
    assert {r.section_id for r in p07_split.split_sections(sections, files).collect()} == {1}


def test_p8_leaks(spark):
    item = "山腰变电站挡墙第9阶，监理拒签给水管道79份记录；要判断质量员签字是否满8人。结论是间距大于105mm即判不合格。依据为GB/T 70301-2015之6.1.5"
    other = item.replace("9阶", "7阶").replace("79份", "21份").replace("105mm", "300mm").replace("8人", "3人")
    docs = {1: "前文。" + item + "后文。", 2: "前文 " + item.replace("，", " <b>，</b>\n")[:70], 3: item.replace("结论是", "判定为").replace("依据为", "缘由引自").replace("拒签", "不签").replace("要判断", "须判断"), 4: other, 5: None, 6: "", 7: "夜间应开启红色示警灯。" * 50}
    got = {(r.doc_id, r.id): r.how for r in p08_leakage.leaked_items(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame([("a", item), ("b", None), ("c", "")], "id string, text string")).collect()}
    assert got == {(1, "a"): "verbatim", (2, "a"): "verbatim", (3, "a"): "reworded", (4, "a"): "reparameterised"}
    with pytest.MonkeyPatch.context() as patch:  # items in blocks give the same
        patch.setattr(p08_leakage, "BLOCK_ITEMS", 1)
        more = spark.createDataFrame([("a", item), ("d", SENTENCES[3] * 3)], "id string, text string")
        pairs = {(r.doc_id, r.id, r.how) for r in p08_leakage.leaked_items(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), more).collect()}
    assert pairs == {(*k, v) for k, v in got.items()} | {(7, "d", "verbatim")}


def test_p8_short_items_and_digits(spark):
    """Items without enough windows, and parts of a long item that are mostly digits, are found by exact pieces."""
    digits = "31415926535897932384626433832795028841971693993751"
    items = {"short": "不小于1.1", "digits": digits, "mixed": "编号" + digits + "的试块应重新送检并由监理单位见证后方可用于主体结构验收"}
    docs = {1: "间距不小于 1.1 米", 2: "见" + digits[5:46] + "号", 3: "编号" + digits[:39], 4: "不小于1.2"}
    got = {(r.doc_id, r.id, r.how) for r in p08_leakage.leaked_items(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "id string, text string")).collect()}
    assert {x for x in got if x[2] == "verbatim"} == {(1, "short", "verbatim"), (2, "digits", "verbatim"), (2, "mixed", "verbatim"), (3, "mixed", "verbatim")}


def test_p8_verbatim_equals_brute_force(spark):
    random.seed(13)
    item = lambda: "".join(random.choices(["基坑", "监测", "12mm", "GB/T 5", "第3阶", "渗水量", "Ålund", "77", "报监理"], k=random.randint(1, 40)))
    items = {f"i{k}": item() for k in range(12)}
    docs = {}
    for k in range(60):
        own = random.choice(list(items.values()))
        a = random.randint(0, len(own))
        docs[k] = item() + own[a : a + random.randint(10, 70)].replace("测", "测 ") + item()
    flat = lambda t: (lambda c: text_of(c[0]))(plain_of([t]))
    want = set()
    for d, text in docs.items():
        for i, own in items.items():
            body, whole = flat(own), flat(text)
            if any(body[k : k + 40] in whole for k in range(max(1, len(body) - 39))):
                want.add((d, i))
    got = p08_leakage.leaked_items(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "id string, text string"))
    assert {(r.doc_id, r.id) for r in got.collect() if r.how == "verbatim"} == want and want


def test_p8_every_part_of_an_item_is_a_candidate():
    """Each 40 plain characters of items with many numbers and names are found, whatever stands around them."""
    random.seed(8)
    for _ in range(20):
        parts = ["第%d阶" % random.randint(1, 99), "GB/T %d" % random.randint(100, 99999), "抗拔力", "Mistral", "105mm", "监理拒签给水管道", "%d" % random.randint(1, 10**9), "结论是"]
        item = "".join(random.choices(parts, k=25))
        ready = p08_leakage.prepare([("a", item)])
        find = p08_leakage.piece_finder(ready)
        for at in range(0, len(ready.plain[0]) - 39, 7):
            codes, bounds = plain_of(["乙" + ready.plain[0][at : at + 40] + "丙"])
            near = list(p08_leakage.candidates(*p08_leakage.templates(codes, bounds), ready)) or find(text_of(codes))
            assert near, (item, at)


def test_p8_plain_characters():
    codes, bounds = plain_of(["Ａb，C１ ㎡", "", "ö"])
    assert [text_of(codes[a:b]) for a, b in zip(bounds, bounds[1:])] == ["abc1m2", "", "ö"]


def test_p9_mixture(spark):
    docs = [(k, "甲乙丙丁" * 20, s, ) for k, s in enumerate(["a"] * 300 + ["B "] * 40 + [None] * 10 + ["other"] * 20)] + [(999, None, "a")]
    mixture = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeat int")
    selection, report = p09_mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), mixture)
    rows = selection.collect()
    assert all(r.copies <= {"a": 1, "b": 3, None: 3}[r.source] for r in rows) and not any(r.source == "other" for r in rows)
    shares = {r.source: r for r in report.collect()}
    assert shares["none"].missed and shares["none"].reason == "no documents"
    assert abs(shares["a"].actual_share - 5 / 9) < 0.05 and abs(shares["b"].actual_share - 4 / 9) < 0.05


def test_p9_rates_are_projected_and_reach_targets(spark):
    """Replayed rates equal those kept by document, stay within caps, and the error falls below CLOSE where targets can be met."""
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.3] * 3, 400)
    tokens, cap = rng.integers(10, 500, 400).astype(float), rng.integers(1, 4, 400).astype(float)
    soft = spark.createDataFrame([(k, a.tolist(), float(c), int(t)) for k, (a, c, t) in enumerate(zip(p, cap, tokens))], "doc_id bigint, posterior array<double>, cap double, tokens bigint")
    hard, targets, repeats = np.array([50_000.0, 30_000.0, 0.0]), np.array([0.5, 0.4, 0.1]), np.array([2.0, 3.0, 1.0])
    gradients, error = p09_mixing.fit_rates(hard, soft, targets, repeats)
    rate, own = np.zeros(400), np.zeros(3)
    for g in gradients:
        rate, own = np.clip(rate + p @ g, 0, cap), np.clip(own + g, 0, repeats)
    assert np.allclose(rate, p09_mixing.replayed(p, cap, gradients)) and (rate >= 0).all() and (rate <= cap).all()
    reached = own * hard + (rate * tokens) @ p
    total = min(2 * 50_000 / (0.5 / 0.9), 3 * 30_000 / (0.4 / 0.9))
    assert error <= p09_mixing.CLOSE and np.allclose(reached[:2], [total * 5 / 9, total * 4 / 9], rtol=2e-3)


def test_p9_refuses_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    mixture = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    selection, report = p09_mixing.mix(docs, mixture)
    assert selection.count() == 0 and [r.reason for r in report.collect()] == ["no documents"]
    many = spark.range(p09_mixing.MOST_SOURCES + 1).selectExpr("cast(id as string) as source", "0.1D as target_share", "1 as max_repeat")
    with pytest.raises(ValueError):
        p09_mixing.mix(docs, many)


def brute_share(text):
    s = "".join(c for c in text if c.isalpha())
    seen, cover = set(), [False] * len(s)
    for k in range(len(s) - 9):
        if s[k : k + 10] in seen:
            cover[k : k + 10] = [True] * 10
        seen.add(s[k : k + 10])
    return sum(cover) / len(s) if len(s) >= 10 else 0.0


def test_p10_share_is_exact():
    random.seed(4)
    for _ in range(60):
        base = "".join(random.choices("甲乙丙ab1 。", k=random.randint(0, 120)))
        text = base + "".join(random.choices("xyz", k=5)) + base[: random.randint(0, len(base))]
        assert abs(p10_repetition.repeated_share(text) - brute_share(text)) < 1e-9


def test_p10_trees_are_monotone():
    rng = np.random.default_rng(5)
    x = rng.random((400, 4))
    model = p10_repetition.fit_trees(x, np.clip(x[:, 1] + 0.3 * rng.random(400), 0, 1))
    base = model.predict(x)
    for k, way in enumerate(p10_repetition.MONOTONE):
        moved = x.copy()
        moved[:, k] += 0.2
        assert way == 0 or (way * (model.predict(moved) - base) >= -1e-12).all()
    assert np.abs(base - x[:, 1]).mean() < 0.25


def test_p10_sample_at_any_size():
    """The share of the hash range that is sampled stays right far beyond what can be tested with rows."""
    for n in (1, 4000, 10**6, 10**10, 10**13):
        kept = (p10_repetition.sample_edge(n) + 2**63) / 2**64 * n
        assert kept == pytest.approx(min(n, 4000), rel=1e-3)


def test_p10_gate_loses_nothing(spark):
    """A phrase before ever new letters: few repeated windows, but half of the letters; whatever the trees were fitted on."""
    fresh = iter(range(0x4E00, 0x9F00))
    mixed = "".join("夜间应开启红色示警灯" + "".join(chr(next(fresh)) for _ in range(9)) for _ in range(60))
    docs = spark.createDataFrame([(1, mixed), (2, "甲" * 9), (3, None)], "doc_id bigint, text string")
    rng = np.random.default_rng(6)
    x = rng.random((500, 4))
    for model in (p10_repetition.fit_trees(x[:0], x[:0, 0]), p10_repetition.fit_trees(x, rng.random(500)), p10_repetition.fit_repetition(docs)):
        found = {r.doc_id: r.share for r in p10_repetition.score_repetition(docs, model, every=False).collect()}
        assert found[1] == pytest.approx(brute_share(mixed)) and found[1] > 0.4
    assert all(r.share is not None for r in p10_repetition.score_repetition(docs, model).collect())


def test_p10_scores(spark):
    docs = spark.createDataFrame([(1, "夜间应开启红色示警灯。" * 30), (2, "".join(map(chr, range(0x4E00, 0x4F00)))), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.share for r in p10_repetition.score_repetition(docs, p10_repetition.fit_repetition(docs)).collect()}
    assert got[1] > 0.9 and not got[2] and not got[3] and not got[4]


def test_extra_columns_and_nulls(spark):
    """Columns that bear the names operators use inside don't disturb them, and null keys and texts don't break them."""
    extra = lambda df: df.withColumns({c: F.lit("x") for c in ("kinds", "n", "share", "v", "e", "cosine", "pairs", "piece", "tokens", "posterior", "bucket", "predicted", "all", "record_n", "token")})
    texts = extra(spark.createDataFrame([(1, "采用Nӧrvіk构件"), (None, "甲"), (2, None)], "rec_id bigint, text string"))
    assert p02_markup.remove_markup(texts).count() == 3
    terms = spark.createDataFrame([("甲",), (None,)], "term string")
    assert p05_distinctive.distinctive_terms(texts, terms).count() == 0
    rows = texts.withColumns({"src_table": F.lit("t"), "row_id": F.col("rec_id"), "codes": F.array(F.lit(None).cast("string")), "names": F.array(F.lit(None).cast("string"))})
    assert {r.text for r in p06_lookalikes.normalise_lookalikes(rows).collect()} == {"采用Nörvik构件", "甲", None}
    assert p01_scans.repair(rows).count() == 2
    entries = extra(spark.createDataFrame([("GBT72261", None), (None, "甲")], "standard_code string, standard_name string"))
    assert p03_canonical.map_to_list(extra(spark.createDataFrame([("GB/T 72261",), (None,)], "value string")), entries).first().standard_code == "GBT72261"
    docs = extra(spark.createDataFrame([(None, "甲乙丙丁" * 20), (1, None)], "doc_id bigint, text string"))
    assert p08_leakage.leaked_items(docs, extra(spark.createDataFrame([("a", "甲乙丙丁" * 12)], "id string, text string"))).count() == 1
    assert p10_repetition.score_repetition(docs, p10_repetition.fit_repetition(docs)).count() == 2
    sections = extra(spark.createDataFrame([("f", 1, 0), ("f", None, 0)], "file string, section_id bigint, pos int"))
    assert p07_split.split_sections(sections, extra(spark.createDataFrame([("f", "甲" * 2100)], "file string, text string"))).filter("piece = 1").count() == 2
