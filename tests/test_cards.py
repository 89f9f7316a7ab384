import pytest
from memtide.functions import modes
from memtide.operators import check, listing, mutate
from memtide.sources import cards, layout
from memtide.sources.image import Image, build
from pyspark.sql import functions as F
from tests.test_codecs import NOW, entry, icon, icon_sys


def folder(name, files, mode=modes.NEW_DIR):
    return layout.Dirent(mode, 0, NOW, 0, 0, NOW, name), files


def image(children):
    return build(layout.geometry_of_mb(8), children, NOW)


GOLDEN = [
    folder("BASLUS-20956Game 1", [entry("icon.sys", icon_sys(b"Larry: MCL", b"Game #00001")), entry("ico.icn", icon()), entry("data", bytes(1000))]),
    folder("BADATA-SYSTEM", [entry("history", b"x" * 100)], modes.NEW_DIR & ~modes.WRITE),
]


@pytest.fixture(scope="module")
def card(spark):
    raw = image(GOLDEN)
    return cards.Cards(spark.createDataFrame([("one", raw), ("junk", b"no card")], "card_id string, content binary").cache())


def test_superblock_and_errors(card):
    got = {r.card_id: r for r in card.superblocks().collect()}
    assert got["one"].clusters == 8192 and got["one"].has_ecc and got["one"].error is None
    assert got["junk"].error.startswith("corrupt")


def test_listing(card):
    rows = card.ls("/").orderBy("slot").collect()
    assert [(r.mode_string, r.length, r.name) for r in rows] == [("rwx--d----+----", 4, "."), ("-wx--d----+--H-", 0, ".."), ("rwx--d----+----", 5, "BASLUS-20956Game 1"), ("r-x--d----+----", 3, "BADATA-SYSTEM")]
    line = listing.ls_text(card.ls("/")).where("slot = 2").first().line
    assert line == "rwx--d----+----       5 2023-11-14 22:13:20 BASLUS-20956Game 1"
    saves = card.saves().orderBy("slot").collect()
    assert [(s.name, s.title1, s.title2, s.size, s.protection) for s in saves] == [("BASLUS-20956Game 1", "Larry: MCL", "Game #00001", 3072 + 1024 + 1024 + 1024, "Not Protected"), ("BADATA-SYSTEM", "Corrupt", "", 3072, "Delete Protected")]
    text = listing.dir_text(card.saves()).orderBy("slot").first()
    assert (text.line1, text.line2) == ("BASLUS-20956Game 1               Larry: MCL", "   6KB Not Protected             Game #00001")
    assert sorted((r.card_id, r.path) for r in card.glob("/BAS*").collect()) == [("junk", "/BAS*"), ("one", "/BASLUS-20956Game 1")] and {r.path for r in card.glob("/z*").collect()} == {"/z*"}
    assert [r.path for r in card.glob("BADATA-SYSTEM/../BADATA-SYSTEM/h*").where("card_id = 'one'").collect()] == ["BADATA-SYSTEM/../BADATA-SYSTEM/history"]
    assert [r.path for r in card.glob("h?story", cwd="/BADATA-SYSTEM").where("card_id = 'one'").collect()] == ["h?story".replace("?", "i")]
    assert card.icons().first().icon.vertex_count == 3


def test_space_is_conserved(card):
    r = card.free_space().first()
    root = 2
    assert r.total_bytes - r.free_bytes == (root + 6 + 3) * 1024
    info = card.info().first()
    assert [s.name for s in info.saves] == ["BASLUS-20956Game 1", "BADATA-SYSTEM"]


def broken(change):
    """An image whose FAT is changed after it was built."""
    from memtide.sources.image import Builder

    b = Builder(layout.geometry_of_mb(8), NOW)
    b.directory(0, (0, 0), GOLDEN)
    change(b)
    return b.image()


def test_check(spark):
    def lose(b):
        b.fat[4000] = layout.CHAIN_END

    def cut(b):
        b.fat[1] = layout.CHAIN_END

    def free(b):
        b.fat[2] = layout.FREE

    def dots(b):
        b.clusters[41 + 1, 64] = ord("x")  # the first save's "."; its directory begins in cluster 1

    images = [("ok", image(GOLDEN)), ("lost", broken(lose)), ("short", broken(cut)), ("open", broken(free)), ("dot", broken(dots))]
    c = cards.Cards(spark.createDataFrame(images, "card_id string, content binary"))
    got = c.check().collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.card_id, set()).add(r.kind)
    assert "ok" not in kinds and kinds["lost"] == {"lost"} and "bad chain" in kinds["short"] and "bad chain" in kinds["open"] and kinds["dot"] == {"bad directory"}
    # the same from tables
    ends = c.endings()
    plain = check.findings(c.fat(), c.chains(), ends.select("card_id", "path", "length"), c.dirents(), ends)
    assert sorted(map(repr, got)) == sorted(map(repr, plain.collect()))


def flipped(raw, cluster, at, *values):
    """An image with bytes of a cluster changed and the codes as they were."""
    out = bytearray(raw)
    for k, v in enumerate(values):
        page, off = divmod(at + k, 512)
        out[(cluster * 2 + page) * 528 + off] ^= v
    return bytes(out)


def test_damaged_cards_are_rows(spark, tmp_path):
    """One card's damage neither ends the job nor hides another card."""
    good = image(GOLDEN)
    times = image([folder("A", [entry("f", b"data")])])
    i = Image(times)
    raw = i.clusters.copy()
    raw[41, 512 + 14 : 512 + 16] = 0xFF  # year 65535 in the root's second entry
    odd = raw.tobytes()
    damaged = {
        "good": good,
        "ecc": flipped(good, 41 + 1, 0, 1, 1),  # the first save's directory: two wrong bits show but can't be mended
        "table": flipped(good, 8, 0, 1, 1),
        "root": flipped(good, 41, 0, *[255] * 40),
        "years": odd,
        "geometry": good[:40] + b"\xff" * 40 + good[80:],
        "cut": good[:100_000],
        "empty": b"",
    }
    bare = bytearray(Image(good).clusters.tobytes())
    bare[8 * 1024 : 8 * 1024 + 4] = b"\xff\xff\xff\x7f"
    damaged["indirect"] = bytes(bare)
    bare[8 * 1024 : 8 * 1024 + 4] = (9).to_bytes(4, "little")
    bare[80:84] = b"\xff\xff\xff\x7f"
    damaged["indirect list"] = bytes(bare)
    c = cards.Cards(spark.createDataFrame(list(damaged.items()), "card_id string, content binary"))
    for t in (c.superblocks, c.pages, c.fat, c.dirents, c.entries, c.chains, c.endings, c.saves, c.free_space, c.check, c.icons, c.sizes, c.info):
        t().count()
    bad = {r.card_id: r for r in c.superblocks().where("error IS NOT NULL").collect()}
    assert {"root", "geometry", "empty", "indirect", "indirect list"} <= set(bad) and not {"good", "ecc", "years"} & set(bad)
    assert {(r.path, r.error.split(":")[0]) for r in c.errors().where("card_id = 'ecc'").collect()} == {("/BASLUS-20956Game 1", "ecc")}
    found = {(r.card_id, r.kind) for r in c.check().collect()}
    assert ("ecc", "unreadable") in found and not any(k == "good" for k, _ in found) and {("indirect", "unreadable"), ("geometry", "unreadable"), ("empty", "unreadable")} <= found
    assert [r.name for r in c.saves().where("card_id = 'ecc'").orderBy("slot").collect()] == ["BASLUS-20956Game 1", "BADATA-SYSTEM"]
    assert c.entries().where("card_id = 'years'").count() == 2 and c.dirents().where("card_id = 'years'").agg({"modified": "max"}).first()[0] is not None
    # codes that don't hold can be left aside
    assert cards.Cards(spark.createDataFrame([("x", bytes(Image(good).clusters.tobytes()))], "card_id string, content binary"), ignore_ecc=True).superblocks().first().has_ecc is False
    zips = cards.read_zips(spark.createDataFrame([("bad", b"PK no zip"), ("none", b"")], "card_id string, content binary")).collect()
    assert {r.card_id for r in zips} == {"bad", "none"} and all(r.error.startswith("format: zip") for r in zips)


def test_parts_of_files_and_folders(spark, tmp_path):
    body = bytes(range(256)) * 10
    c = cards.Cards(spark.createDataFrame([("one", image([folder("A", [entry("f", body)])])), ("two", image([]))], "card_id string, content binary"))
    for lo, n in ((0, None), (1000, 1100), (2559, 10), (0, 0), (5000, 4), (1024, 1024)):
        (r,) = c.file("/A/f", lo, n).collect()
        assert r.data == (body[lo:] if n is None else body[lo : lo + n]) and r.length == len(body)
    assert c.file("f", cwd="/A/").count() == 1 and c.file("/A").count() == 0
    e = c.entries()
    now = F.lit(NOW).cast("long")
    put = lambda at, data: mutate.write_at(e, spark.createDataFrame([("one", "/A/f", at, data)], "card_id string, path string, offset long, data binary"), now).where("path = '/A/f'").first().data
    assert put(3, b"xy") == body[:3] + b"xy" + body[5:] and put(3000, b"z") == body + bytes(440) + b"z" and put(2558, b"abc") == body[:2558] + b"abc"
    assert {r.card_id: r.bytes for r in c.allocatable().collect()} == dict.fromkeys(("one", "two"), layout.geometry_of_mb(8).limit * 1024)
    (tmp_path / "B").mkdir()
    for n in "zab":
        (tmp_path / "B" / n).write_bytes(n.encode())
    got = cards.read_folders(spark, str(tmp_path / "B")).orderBy("slot").collect()
    assert [(r.path, r.slot, r.data and bytes(r.data)) for r in got] == [("/B", None, None), ("/B/a", 2, b"a"), ("/B/b", 3, b"b"), ("/B/z", 4, b"z")]
    d = folder("A", [])[0]
    assert d.changed(name="B").name == "B" and d.changed(name="B").mode == d.mode


@pytest.fixture(scope="module")
def entries(card):
    return card.entries().cache()


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_mutations(spark, entries):
    now = F.lit(NOW).cast("long")
    ask = lambda *p: spark.createDataFrame([("one", x) for x in p], "card_id string, path string")
    made, no = mutate.mkdir(entries, ask("/NEW", "/BADATA-SYSTEM", "/none/x"), now)
    assert "/NEW" in paths(made) and {(r.path, r.reason) for r in no.collect()} == {("/BADATA-SYSTEM", "directory exists"), ("/none/x", "path not found")}
    put = mutate.put_files(made, spark.createDataFrame([("one", "/NEW/f", b"12345")], "card_id string, path string, data binary"), now)
    more = mutate.put_files(put, spark.createDataFrame([("one", "/NEW/f", b"67")], "card_id string, path string, data binary"), now, append=True)
    assert more.where("path = '/NEW/f'").first().data == b"1234567"
    left, no = mutate.remove(more, ask("/NEW", "/NEW/f", "/nothing"))
    assert "/NEW/f" not in paths(left) and {r.reason for r in no.collect()} == {"directory not empty", "file not found"}
    assert paths(mutate.remove_tree(more, ask("/BASLUS-20956Game 1", "/"))) == ["/BADATA-SYSTEM", "/BADATA-SYSTEM/history", "/NEW", "/NEW/f"]
    moves = spark.createDataFrame([("one", "/NEW", "/OLD"), ("one", "/BADATA-SYSTEM", "/BADATA-SYSTEM/in")], "card_id string, path string, target string")
    moved, no = mutate.rename(more, moves)
    assert "/OLD/f" in paths(moved) and "/NEW" not in paths(moved) and [r.reason for r in no.collect()] == ["beneath itself"]
    flagged = mutate.set_modes(more, ask("/NEW/f"), set_bits=modes.PROTECTED, clear_bits=modes.WRITE | modes.FILE).where("path = '/NEW/f'").first()
    assert flagged.mode == (modes.NEW_FILE | modes.PROTECTED) & ~modes.WRITE
    again = cards.Cards(cards.encode_images(more, 8, NOW))
    assert paths(again.entries()) == paths(more) and again.check().count() == 0


def test_import_export(spark, card, entries):
    psu = card.export("psu").where("name LIKE 'BAS%'").select("card_id", "content")
    saves = cards.read_saves(psu, NOW).drop("error")
    for rule, n in (("error", 1), ("skip", 0), ("replace", 0)):
        got, no = mutate.import_saves(entries, saves, rule)
        assert paths(got) == paths(entries) and no.count() == n, rule
    bad = cards.read_saves(spark.createDataFrame([("x", b"short"), ("y", b"CFU\0" + bytes(60))], "card_id string, content binary"))
    assert {r.error.split(":")[0] for r in bad.collect()} == {"unsupported"}
    files, no = mutate.export_save(entries, spark.createDataFrame([("one", "/BADATA-SYSTEM")], "card_id string, path string"))
    assert paths(files) == ["/BADATA-SYSTEM/history"] and no.count() == 0
    both = cards.convert(psu, "max", NOW).first()
    assert both.error is None and both.content[:12] == b"Ps2PowerSave"


def test_card_files(spark, tmp_path, card):
    (tmp_path / "a.ps2").write_bytes(image(GOLDEN))
    got = cards.read_cards(spark, str(tmp_path)).free_space().first()
    assert got.free_bytes == card.free_space().first().free_bytes
    full = cards.encode_images(cards.read_cards(spark, str(tmp_path)).entries().withColumn("data", F.expr("cast(repeat('x', 9000000) AS binary)")), 8, NOW).first()
    assert full.content is None and full.error.startswith("no_space")


def test_slots(spark):
    d = spark.createDataFrame([("c", "/", s, modes.NEW_FILE if s != 3 else modes.NEW_FILE & ~modes.EXISTS) for s in range(5)], "card_id string, dir_path string, slot int, mode int")
    assert mutate.first_free_slot(d).first().free_slot == 3
    new = spark.createDataFrame([("c", "/", n) for n in "ab"], "card_id string, dir_path string, name string")
    assert {r.name: r.slot for r in mutate.assign_slots(new, d).collect()} == {"a": 3, "b": 5}


def test_pages(card):
    """Only the erased block of the superblock's spare copy has pages without true codes."""
    assert card.pages().where("state <> 0").count() == 16


def test_slots_are_kept_and_used_again(spark):
    names = lambda c: {r.slot: r.name for r in c.entries().where("parent = ''").collect()}
    c = cards.Cards(spark.createDataFrame([("one", image([folder(n, [entry("f", b"1")]) for n in "ABCD"]))], "card_id string, content binary"))
    left = mutate.remove_tree(c.entries(), spark.createDataFrame([("one", "/B"), ("one", "/C")], "card_id string, path string"))
    holes = cards.Cards(cards.encode_images(left, 8, NOW))
    assert names(holes) == {2: "A", 5: "D"} and holes.check().count() == 0
    made, _ = mutate.mkdir(holes.entries(), spark.createDataFrame([("one", f"/{n}") for n in ("Z", "X", "Y")], "card_id string, path string"), F.lit(NOW).cast("long"))
    again = cards.Cards(cards.encode_images(made, 8, NOW))
    assert names(again) == {2: "A", 3: "X", 4: "Y", 5: "D", 6: "Z"} and again.check().count() == 0
    assert again.mode("X").first().mode == modes.NEW_DIR and again.mode("/").first().mode & modes.DIR and again.mode("/B").count() == 0
