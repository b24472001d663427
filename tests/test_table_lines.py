"""Tables read as whole strings, tag by tag and place by place are the same; a page's named columns leave it in one pass."""

import random

from paddock.sources import cards, pages, tables

ODD = ["<!-- <table> -->", "<script>'<td>'</script>", "<td class='a>b'>", "<TD>", "<th colspan=2>", "<td rowspan='2'>", "<thead>", "</thead>", "<tr id=1>", "<table border=1>", "</table >"]
BARE = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "a", " b ", "<b>c</b>", "&amp;", "\n", "İ"]


def of_places(html):
    out = {}
    for number, depth, row, column, body, _, _ in tables.table_cells(html):
        out.setdefault((number, depth), {}).setdefault(row, {}).setdefault(column, body)
    return [(n, d, [(r, [c.get(k) for k in range(max(c) + 1)]) for r, c in rows.items()]) for (n, d), rows in out.items()]


def test_all_ways_read_the_same():
    dice, bare = random.Random(2), 0
    for k in range(6000):
        parts = dice.choices(BARE + ODD * (k % 2), k=dice.randrange(1, 25))
        if k % 3 == 0:  # mostly well-formed
            parts = [f"<table>{''.join(f'<tr>{chr(10) * dice.randrange(2)}' + ''.join(f'<td>{dice.choice(parts)}</td>' for _ in range(dice.randrange(4))) + '</tr>' for _ in range(3))}</table>" for _ in range(3)]
        html = "".join(parts)
        assert tables.table_lines(html) == of_places(html), html
        bare += tables.bare_lines(html) is not None
    assert 1000 < bare < 5000


def test_bare_pages_need_no_walk_over_tags(monkeypatch):
    class No:
        def finditer(self, html):
            raise AssertionError("walked")

    monkeypatch.setattr(tables, "TAG", No())
    html = "<table><thead><tr><th>N</th><th>HP</th></tr></thead><tr><td>1</td><td>7</td></tr>\n<tr><td>2</td></tr></table>"
    assert tables.table_lines(html) == [(0, 0, [(0, ["N", "HP"]), (1, ["1", "7"]), (2, ["2"])])]


def test_named_rows_are_the_named_columns(spark):
    dice, made = random.Random(4), []
    for k in range(60):
        heads = [x for x in ("N", "At <i>İsmi</i>", "JOKEY", "Sıklet ", "AGF", "x", "N")]
        dice.shuffle(heads)
        lines = [[dice.choice(["", "1", "K &amp; L", " a\n b ", "<b>c</b>", "5  6"]) for _ in range(dice.randrange(8))] for _ in range(dice.randrange(6))]
        lines.insert(dice.randrange(min(len(lines), 4) + 1), heads[: dice.randrange(1, 8)])
        table = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in line) + "</tr>" for line in lines) + "</table>"
        made.append((k, f"<table><tr><td rowspan=2>y</table>{table}<h3>z</h3>{table[:-8] * (k % 3)}" + "<table><tr><td>1" * (k % 2)))
    df = spark.createDataFrame([*made, (98, None), (99, "")], "page_id long, html string")
    want = pages.named_columns(pages.tables(df), cards.CARD_HEADERS)
    got = pages.named_rows(df, cards.CARD_HEADERS)
    assert got.schema == want.schema and want.count() > 100
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and "Generate" not in got._jdf.queryExecution().executedPlan().toString()
