import os
import zipfile

from memtide import cli
from tests.test_codecs import icon_sys


def test_one_card(spark, tmp_path, capsys):
    card, out = str(tmp_path / "a.ps2"), tmp_path / "out"
    folder = tmp_path / "BASLUS-1"
    folder.mkdir()
    (folder / "icon.sys").write_bytes(icon_sys(b"Title", b"two"))
    (folder / "data").write_bytes(b"x" * 1500)
    assert cli.run([card, "format"]) == 0 and os.path.getsize(card) == 8650752
    assert cli.run([card, "format"]) == 1  # exists
    assert cli.run([card, "import", str(folder)]) == 0
    assert cli.run([card, "import", str(folder)]) == 1 and cli.run([card, "import", str(folder), "--ignore-existing"]) == 0
    capsys.readouterr()
    assert cli.run([card, "dir"]) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["BASLUS-1                         Title", "   5KB Not Protected             two"]
    assert cli.run([card, "export", "BASLUS-*", "--directory", str(out), "--long-names"]) == 0 and cli.run([card, "export", "none", "--directory", str(out)]) == 1
    assert os.listdir(out) == ["BASLUS-1 Titletwo.psu"]
    assert cli.run([card, "export-all", "--directory", str(tmp_path / "all")]) == 0
    assert sorted(os.listdir(tmp_path / "all")) == ["BASLUS-1"] and (tmp_path / "all" / "BASLUS-1" / "data").read_bytes() == b"x" * 1500
    assert cli.run([card, "export-all", "--directory", str(tmp_path / "all")]) == 1
    assert cli.run([card, "export-all-zip", "--directory", str(tmp_path / "z")]) == 0 and cli.run([card, "export-all-zip", "--directory", str(tmp_path / "z")]) == 1
    with zipfile.ZipFile(tmp_path / "z" / "a.zip") as z:
        assert sorted(z.namelist()) == ["BASLUS-1/data", "BASLUS-1/icon.sys"]
    assert cli.run(["--ignore-ecc", card, "df"]) == 1  # with codes in it the card is none without
    assert cli.run([str(out / "BASLUS-1 Titletwo.psu"), "convert", str(tmp_path / "a.max")]) == 0
    assert cli.run([card, "delete", "BASLUS-1"]) == 0 and cli.run([card, "check"]) == 0
    capsys.readouterr()
    assert cli.run([card, "df"]) == 0 and "8329216 bytes free" in capsys.readouterr().out
    assert cli.run([str(tmp_path / "none.ps2"), "help"]) == 0 and cli.run([str(tmp_path / "none.ps2"), "u"]) == 0
