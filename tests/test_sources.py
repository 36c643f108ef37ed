"""Sources on small generated files."""

import json
import random
import re
import zipfile
from collections import Counter

from pyspark.sql import functions as F

from gristmill.sources import chats, pages, sheets

CHAT = """‎[1/2/24, 9:00:00 AM] Group: ‎Messages are end-to-end encrypted
[1/2/24, 9:01:05 AM] Ana Stone: Hello there
second line
[1/2/24, 9:02:00 PM] Bo: ‎<attached: photo-1.jpg>
[1/3/2024, 10:00:00 AM] Ana Stone: Almost there ‎image omitted
[1/3/24, 10:05:00 AM] Bo: ‎image omitted
[1/3/24, 10:06:00 AM] Bo: ok
[1/3/24, 10:07:00 AM] Cy: ask Ana about it
"""


def test_chat_export(spark, tmp_path):
    (tmp_path / "alpha.txt").write_text(CHAT, encoding="utf-8")
    raw = chats.messages(chats.read_text(spark, str(tmp_path / "alpha.txt")))
    got = chats.classify(raw).orderBy("n").collect()
    assert [(r.sender, r.body, r.media_ref) for r in got] == [
        ("Ana Stone", "Hello there\nsecond line", None),
        ("Bo", "", "photo-1.jpg"),
        ("Ana Stone", "Almost there", None),
        ("Bo", "ok", None),
        ("Cy", "ask Ana about it", None),
    ]
    assert [str(r.ts) for r in got][:3] == ["2024-01-02 09:01:05", "2024-01-02 21:02:00", "2024-01-03 10:00:00"]
    assert {r.sender: r.messages for r in chats.senders(chats.classify(raw)).collect()} == {"Ana Stone": 2, "Bo": 2, "Cy": 1}
    assert [r.sender for r in chats.mentions(chats.classify(raw), "Ana Stone").collect()] == ["Cy"]
    with zipfile.ZipFile(tmp_path / "beta.zip", "w") as z:
        z.writestr("_chat.txt", CHAT)
    assert [r.source for r in chats.unzip(spark, str(tmp_path / "beta.zip")).collect()] == ["beta"]


GRID = """Camp shifts,,,,
,Monday,,Tuesday,Wednesday
Kitchen,,,,
Breakfast,Ana,Bo,Cy,TBD
Dinner,Dee,,,"Eve, Jr"
Bar,,,,
Late,,,Flo,
"""


def test_grid_and_text(spark, tmp_path):
    (tmp_path / "grid_2024.csv").write_text(GRID)
    cells = sheets.cells(spark, str(tmp_path / "grid_2024.csv"))
    got = {(r.category, r.shift, r.day, r.person) for r in sheets.grid(cells).collect()}
    assert got == {("Kitchen", "Breakfast", "Monday", "Ana"), ("Kitchen", "Breakfast", "Monday", "Bo"), ("Kitchen", "Breakfast", "Tuesday", "Cy"), ("Kitchen", "Dinner", "Monday", "Dee"), ("Kitchen", "Dinner", "Wednesday", "Eve, Jr"), ("Bar", "Late", "Tuesday", "Flo")}
    text = sheets.as_text(cells).first().text
    assert text.split("\n")[3] == "Breakfast | Ana | Bo | Cy | TBD"
    assert sheets.as_text(cells, limit=20).first().text.endswith("[...]")
    assert sheets.sniff(spark, str(tmp_path / "grid_2024.csv")) == ","


def brute_grid(cells):
    """The rule of ``sheets.grid``, file by file in plain Python."""
    out = []
    for file in {c[0] for c in cells} - {None}:
        rows = {}
        for name, row, col, cell in cells:
            if name == file and row is not None and cell:
                rows.setdefault(row, []).append((col, cell))
        day = lambda cell: next((d for d in sheets.DAYS if re.match(rf"{d}\b", cell.lower())), None)
        head = next((r for r in sorted(rows) if r < 25 and len({day(c) for _, c in rows[r]} - {None}) >= 3), None)
        if head is None:
            continue
        days, category = sorted((k, day(c)) for k, c in rows[head] if day(c) and k is not None), None
        for r in sorted(r for r in rows if r > head):
            own = sorted((k, c) for k, c in rows[r] if k is not None)
            if len(rows[r]) == 1 and own and own[0][0] == 0:
                category = own[0][1]
            elif own and own[0][0] == 0:
                out += [(file, category, own[0][1], d[-1][1].capitalize(), c) for k, c in own if k > 0 and c != "TBD" and (d := [x for x in days if x[0] <= k])]
    return Counter(out)


def test_odd_grids(spark):
    rnd = random.Random(7)
    cells = [("far", r, c, t) for r, c, t in [(24, 1, "Monday"), (24, 2, "Tuesday"), (24, 3, "Friday"), (25, 0, "early"), (25, 2, "Ana")]]
    cells += [("late", 25, 1, "Monday"), ("late", 25, 2, "Tuesday"), ("late", 25, 3, "Friday"), ("late", 26, 0, "x"), ("late", 26, 2, "Bo"), (None, 1, 1, "Monday")]
    cells += [("above", 1, 0, "not a category"), ("above", 2, 1, "Sunday"), ("above", 2, 2, "Monday"), ("above", 2, 2, "Tuesday 4th"), ("above", 3, 0, "dawn"), ("above", 3, 1, "Cy"), ("above", 3, 2, "Dee"), ("above", 3, 2, "Dee"), ("above", 3, None, "Eve")]
    for f in range(60):
        for r in range(12):
            for c in range(7):
                t = rnd.choice(["", None, "Monday", "tuesday, 2nd", "Friday", "Mondays"] if r < 4 else ["", "", None, "TBD", "Ana", "Bo", "Sunday"])
                cells.append((f"f{f}", r, rnd.choice([c, None]) if rnd.random() < 0.02 else c, t if rnd.random() < 0.8 and (r % 3 or c == 0) else ""))
    got = sheets.grid(spark.createDataFrame(rnd.sample(cells, len(cells)), "file string, row int, col int, cell string").repartition(3))
    assert Counter(map(tuple, got.collect())) == brute_grid(cells)


def test_grid_reads_its_cells_once(spark):
    cells = spark.createDataFrame([("f", 0, 1, "Monday")], "file string, row int, col int, cell string")
    plan = sheets.grid(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_rosters_over_years(spark):
    rows = spark.createDataFrame([("Ana 'Sun' Stone", "ANA@x.org", "Yesssss", ""), ("Bo Li", "", "maybe/yes", "420"), ("~", "", "", ""), ("Cy Ray", "", "No. :(", "0")], "who string, mail string, rsvp string, dues string")
    y = {"name": "who", "email": "mail", "status": "rsvp"}
    got = {r["first"]: (r["last"], r.nickname, r.email, r.status) for r in sheets.read_roster(rows, y, 2023, commitments=("dues",)).collect()}
    assert got == {"Ana": ("Stone", "Sun", "ana@x.org", "attending"), "Bo": ("Li", "", "", "attending"), "Cy": ("Ray", "", "", "not")}
    both = sheets.read_roster(rows, y, 2023).unionByName(sheets.read_roster(rows, y | {"status": None}, 2024))
    people = {r.key: r for r in sheets.roster(both).collect()}
    assert people["ana@x.org"].years == [2023, 2024] and people["ana@x.org"].statuses == {2023: "attending", 2024: "listed"}
    assert {r.year: r.people for r in sheets.head_counts(both).collect()} == {2023: 1}


LISTING = {
    "events": [{"title": "Tea Tea", "camp": "A", "address": "", "tags": ["x"], "about": "calm"}, {"title": "Run", "camp": "B", "address": "", "tags": [], "about": ""}],
    "days": [{"name": "Sun", "date": "08-25", "slots": [{"e": 0, "at": "10:00", "to": "11:00"}, {"e": 0, "at": "10:00", "to": "11:00"}, {"e": 0}, None and {} or {"e": 1, "at": "08:00"}]}, {"name": "", "date": "", "slots": [{"e": 1}]}],
}


def test_listing(spark, tmp_path):
    (tmp_path / "guide.js").write_text("window.GUIDE = " + json.dumps(LISTING) + ";")
    listing = pages.read_wrapped_json(spark, str(tmp_path / "guide.js"), pages.LISTING)
    slots = pages.occurrences(listing)
    got = {(r.title, r.date, r["at"]) for r in slots.collect()}
    assert got == {("Tea", "08-25", "10:00"), ("Run", "08-25", "08:00"), ("Run", "", "")}
    days = pages.listing_days(slots)
    assert pages.opening_day(days, "08-26", least=1).first().date == "08-25"


def test_documents_journal_and_blobs(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head {#x}\n\n\n\n" + "text " * 20 + "\n## Sub\nmore")
    (tmp_path / "b.md").write_text("short")
    md = pages.markdown(spark, str(tmp_path / "*.md"))
    assert md.count() == 1 and "\n\n\n" not in md.first().text
    s = pages.sections(md.withColumn("doc_id", F.lit(1))).orderBy("n").collect()
    assert [(r.heading, r.body[:4]) for r in s if r.heading] == [("Head", "text"), ("Sub", "more")]
    journal = "MODEL: m1\nQUESTION: who?\nFACTS GIVEN:\n- a\n- b\nANSWERED:\nAna.\n----\nQUESTION: none?\nANSWERED:\n\n----\nQUESTION: when?\nEMPTY-HANDED, COLOUR GIVEN:\n- c\nANSWERED:\nnow"
    rows = pages.journal(spark.createDataFrame([("j", journal)], "source string, text string")).collect()
    assert [(r.question, r.facts, r.answer, r.model) for r in rows] == [("who?", "- a\n- b", "Ana.", "m1"), ("when?", "- c", "now", "m1")]
    (tmp_path / "x.bin").write_bytes(b"same")
    (tmp_path / "y.bin").write_bytes(b"same")
    assert pages.blobs(spark, str(tmp_path / "*.bin")).count() == 1
    html = "<table><tr><td>a&amp;b</td><td><b>c</b></td></tr></table>"
    assert [(r.row, r.col, r.cell) for r in pages.tables_in(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()] == [(0, 0, "a&b"), (0, 1, "c")]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:t>Title</w:t></w:p><w:p ><w:t>Body </w:t><w:t xml:space="preserve">text</w:t></w:p>')
    assert pages.docx(spark, str(tmp_path / "d.docx")).first().text == "## Title\n\nBody text"
