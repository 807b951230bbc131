import datetime as dt
import email.message
import io
import sqlite3
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quaero.sources import browser, files
from quaero.streaming.rounds import Snapshots, binary_files, run_round, stream_rounds


def docx(*lines):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:document>")
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>naam</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<sheetData><row><c t="s"><v>0</v></c><c t="s"><v>9</v></c><c><v>12</v></c></row><row><c></c></row><row><c t="inlineStr"><is><t>x &amp; y</t></is></c></row></sheetData>')
    return out.getvalue()


def mail(subject, body, date="Thu, 05 Mar 2026 10:12:00 +0200"):
    m = email.message.EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = "An <an@example.org>", "bo@example.org", subject, date
    m.set_content(body)
    return bytes(m)


def test_extractors():
    pdf = b"1 0 obj <</Length 9>> stream\nBT (Factuur \\(kop\\)) Tj 0 -14 Td (\\101B) Tj ET\nendstream"
    packed = b"2 0 obj <</Filter /FlateDecode>> stream\n" + zlib.compress(b"BT (Diep) Tj ET") + b"\nendstream"
    assert files.extract_one("a.pdf", pdf + packed)[1] == "Factuur (kop)\nAB\nDiep"
    assert files.extract_one("a.docx", docx("een", "twee &amp; drie"))[1] == "een\ntwee & drie"
    assert files.extract_one("a.xlsx", xlsx())[1] == "[sheet1]\nnaam | 12\nx & y"
    assert files.extract_one("a.docx", b"no zip")[3].startswith("damaged")
    title, body, extra, error = files.extract_one("a.eml", mail("Aanbesteding één", "hallo"))
    assert (title, body, extra["moment"], error) == ("Aanbesteding één", "hallo", "2026-03-05 10:12", "")
    box = b"From x\n" + mail("a", "1") + b"\nFrom y\n" + mail("b", "2", "Fri, 06 Mar 2026 09:00:00 +0000")
    assert files.extract_one("a.mbox", box)[2] == {"berichten": "2", "moment": "2026-03-06 09:00"}
    frames = b"".join(n + len(v).to_bytes(4) + b"\0\0" + v for n, v in ((b"TIT2", b"\x00Gold Days"), (b"TPE1", b"\x03Mr. Probz")))
    assert files.music(b"ID3\x03\0\0" + bytes([0, 0, len(frames) >> 7, len(frames) & 127]) + frames) == {"muziektitel": "Gold Days", "artiest": "Mr. Probz"}
    assert files.music(b"x" * 200 + b"TAG" + b"Titel".ljust(30, b"\0") + b"Wie".ljust(30, b"\0") + b"\0" * 65)["artiest"] == "Wie"
    assert files.decode("café".encode("cp1252")) == "café" and files.decode("﻿x".encode("utf-16")) .endswith("x")


def test_pdf_fonts_with_a_table():
    table = zlib.compress(b"2 beginbfchar <01> <0054> <02> <006F> endbfchar 2 beginbfrange <10> <12> [<0036> <0039> <0032>] <20> <22> <00FF> endbfrange")
    wide = b"1 beginbfrange <0003> <0005> <0061> endbfrange"
    shown = zlib.compress(b"BT /F1 12 Tf 72 720 Td <01> Tj <0210> Tj <1112> Tj <202> Tj T* /F2 9.5 Tf [<00030004> -20 <0005>] TJ /F3 9 Tf (x) Tj ET")
    obj = lambda n, x: b"%d 0 obj\n" % n + x + b"\nendobj\n"
    packed = lambda x: b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(x) + x + b"\nendstream"
    raw = b"%PDF-1.4\n" + obj(1, b"<< /Type /Page /Resources << /Font << /F1 2 0 R /F2 3 0 R >> >> /Contents 6 0 R >>")
    raw += obj(2, b"<< /Type /Font /Subtype /TrueType /ToUnicode 4 0 R >>") + obj(3, b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>")
    raw += obj(4, packed(table)) + obj(5, b"<< /Length 1 >>\nstream\n" + wide + b"\nendstream") + obj(6, packed(shown))
    assert files.extract_one("a.pdf", raw)[1] == "To692\xff\xff\nabcx"  # an odd digit count ends in a 0
    assert files.glyphs(b"beginbfrange <00> <01> <FFFF> endbfrange")[1] == "\0" and files.glyphs(b"") == {}
    assert files.extract_one("a.pdf", b"%PDF")[3] != ""


def test_music_of_flac_and_old_tags():
    size = lambda x: len(x).to_bytes(4, "little") + x
    comments = [b"title=Gold Days", b"ARTIST=Een", b"ARTIST=Twee", b"x=y", b"ALBUM=", "DATE=2014é".encode()]
    block = size(b"writer") + len(comments).to_bytes(4, "little") + b"".join(map(size, comments))
    raw = b"fLaC" + b"\0" + (2).to_bytes(3) + b"ab" + b"\x84" + len(block).to_bytes(3) + block
    assert files.music(raw) == {"muziektitel": "Gold Days", "artiest": "Een & Twee", "jaar": "2014é"}
    for cut in range(len(raw)):
        files.music(raw[:cut])
    frame = b"TT2" + (6).to_bytes(3) + b"\0Titel" + b"TP1" + (4).to_bytes(3) + b"\0Wie"
    assert files.music(b"ID3\x02\0\0" + bytes([0, 0, 0, len(frame)]) + frame) == {"muziektitel": "Titel", "artiest": "Wie"}


def tree(root):
    for name, raw in {
        "notulen.md": b"# Notulen overleg\ntekst", "node_modules/pakket.js": b"x", "Windows/systeem.txt": b"x", ".git/config": b"x", "post.eml": mail("Hallo", "dag"), "foto.jpg": b"\xff",
        "sub/.verborgen.txt": b"ook dit telt", "sub/site.html": b"<title>Kop</title><p>tekst &eacute;</p>", "desktop.ini": b"x", "x.bin": b"x",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)


def test_walk_prunes_and_selects(spark, tmp_path):
    tree(tmp_path)
    names = lambda kind: sorted(r.path[len(str(tmp_path)) + 1 :] for r in files.files(spark, [str(tmp_path)], kind).collect())
    assert names("bestanden") == ["notulen.md", "post.eml", "sub/.verborgen.txt", "sub/site.html"]
    assert names("bestanden-zonder-mail") == ["notulen.md", "sub/.verborgen.txt", "sub/site.html"]
    assert names("mail") == ["post.eml"] and names("beeld") == ["foto.jpg"]


def test_rounds(spark, tmp_path):
    root = tmp_path / "files"
    tree(root)
    snapshots = Snapshots(spark, f"file://{tmp_path}/index")
    found = lambda: files.files(spark, [str(root)]).withColumn("source", F.lit("map"))
    assert run_round(snapshots, found()) == {"added": 4, "updated": 0, "skipped": 0, "errors": 0, "documents": 4, "removed": 0}
    rows = {r.path.rsplit("/", 1)[1]: r for r in snapshots.documents().collect()}
    assert (rows["notulen.md"].title, rows["site.html"].text, rows["post.eml"].title) == ("Notulen overleg", "Kop tekst é", "Hallo")
    assert rows["post.eml"].mtime == dt.datetime(2026, 3, 5, 10, 12)
    assert run_round(snapshots, found())["skipped"] == 4
    (root / "notulen.md").write_bytes(b"# Een langere kop dan eerst")
    (root / "sub/site.html").unlink()
    got = run_round(snapshots, found())
    assert (got["updated"], got["removed"], got["skipped"], got["documents"]) == (1, 1, 2, 3)
    (root / "post.eml").unlink()
    assert run_round(snapshots, found(), completed=[])["removed"] == 0  # a source that was not walked to the end


def test_stream_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("eerste bestand")
    snapshots = Snapshots(spark, f"file://{tmp_path}/index")
    for n, extra in ((1, None), (2, "b.txt")):
        if extra:
            (tmp_path / "in" / extra).write_text("tweede bestand")
        q = stream_rounds(snapshots, binary_files(spark, str(tmp_path / "in"), "map"), str(tmp_path / "check"))
        q.awaitTermination()
        assert snapshots.documents().count() == n


def test_history(spark, tmp_path):
    folder = tmp_path / "User Data" / "Default"
    folder.mkdir(parents=True)
    con = sqlite3.connect(folder / "History")
    con.execute("CREATE TABLE urls(url, title, last_visit_time INTEGER, visit_count INTEGER)")
    con.executemany("INSERT INTO urls VALUES(?,?,?,?)", [("http://a.nl:8/x", "A", 13_350_000_000_000_000, 2), ("http://b.nl/", "", 0, 1)])
    con.commit()
    icons = sqlite3.connect(folder / "Favicons")
    icons.execute("CREATE TABLE icon_mapping(page_url, icon_id)")
    icons.execute("CREATE TABLE favicon_bitmaps(icon_id, image_data BLOB)")
    icons.execute("INSERT INTO icon_mapping VALUES('http://a.nl:8/x', 1)")
    icons.executemany("INSERT INTO favicon_bitmaps VALUES(?,?)", [(1, None), (1, b"png")])
    icons.commit()
    rows = browser.visits(spark, browser.profiles(str(tmp_path)))
    r = rows.collect()
    assert [(x.url, x.host, x.visits, bytes(x.image)) for x in r] == [("http://a.nl:8/x", "a.nl:8", 2, b"png")]
    assert browser.visit_documents(rows).first().text == "http://a.nl:8/x\nA\n17-01-2024 21:20\nchrome"


def test_plan_stops_resumes_and_forgets_folders(spark, tmp_path):
    from quaero.streaming.plan import Settings, plan, run_plan

    for n in "abc":
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.txt").write_text(f"tekst van {n}")
    settings, snapshots = Settings(spark, f"file://{tmp_path}/index"), Snapshots(spark, f"file://{tmp_path}/index")
    for n in "abc":
        settings.add_folder(str(tmp_path / n))
    assert settings.folders() == [str(tmp_path / n) for n in "abc"]
    chosen = plan(settings.folders())
    got = run_plan(settings, snapshots, chosen, stop_after=1)
    assert (got["added"], got["pending"], got["status"]) == (1, 2, "onderbroken")
    got = run_plan(settings, snapshots, [])
    assert (got["added"], got["resumed"], got["pending"], got["status"]) == (2, 1, 0, "klaar")
    assert run_plan(settings, snapshots, chosen)["skipped"] >= 3
    settings.remove_folder(str(tmp_path / "a"), snapshots)
    assert len(settings.folders()) == 2 and snapshots.documents().count() == 2


@pytest.mark.parametrize("stop", [1, 2, 3])
def test_resumed_plan_loses_nothing(spark, tmp_path, stop):
    from quaero.streaming.plan import Settings, plan, run_plan

    for n in ("m1", "m2", "own"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.eml").write_bytes(mail(f"van {n}", "dag"))
    (tmp_path / "own/y.txt").write_text("tekst")
    settings, snapshots = Settings(spark, f"file://{tmp_path}/index"), Snapshots(spark, f"file://{tmp_path}/index")
    settings.add_folder(str(tmp_path / "own"))
    chosen = plan(settings.folders(), [str(tmp_path / "m1"), str(tmp_path / "m2")])
    assert run_plan(settings, snapshots, chosen)["added"] == 3
    held = lambda: sorted(r.path[len(str(tmp_path)) + 1 :] for r in snapshots.documents().select("path").collect())
    assert held() == ["m1/x.eml", "m2/x.eml", "own/y.txt"]
    got = run_plan(settings, snapshots, chosen, stop_after=stop)
    assert (got["removed"], got["added"]) == (0, 0)
    (tmp_path / "m1/x.eml").unlink()
    (tmp_path / "m2/new.eml").write_bytes(mail("nieuw", "dag"))
    got = run_plan(settings, snapshots, chosen)
    assert got["status"] == "klaar" and held() == ["m2/new.eml", "m2/x.eml", "own/y.txt"]


def test_item_stays_queued_if_its_round_dies(spark, tmp_path, monkeypatch):
    from quaero.streaming import plan as planned

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("tekst")
    settings, snapshots = planned.Settings(spark, f"file://{tmp_path}/index"), Snapshots(spark, f"file://{tmp_path}/index")
    chosen = planned.plan([str(tmp_path / "a")])

    def dies(*_):
        raise OSError("stroom weg")

    with monkeypatch.context() as m:
        m.setattr(planned, "run_round", dies)
        with pytest.raises(OSError):
            planned.run_plan(settings, snapshots, chosen)
    got = planned.run_plan(settings, snapshots, [])
    assert (got["resumed"], got["added"], got["status"]) == (1, 1, "klaar")


def test_folder_removal_keeps_mail_below_it(spark, tmp_path):
    from quaero.streaming.plan import Settings, plan, run_plan

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.eml").write_bytes(mail("post", "dag"))
    (tmp_path / "a/y.txt").write_text("tekst")
    settings, snapshots = Settings(spark, f"file://{tmp_path}/index"), Snapshots(spark, f"file://{tmp_path}/index")
    settings.add_folder(str(tmp_path / "a"))
    run_plan(settings, snapshots, plan(settings.folders(), [str(tmp_path / "a")]))
    settings.remove_folder(str(tmp_path / "a"), snapshots)
    assert [r.source for r in snapshots.documents().collect()] == ["mail:bestanden"]


def test_unchanged_round_writes_no_document_and_layers_are_joined(spark, tmp_path, monkeypatch):
    from quaero.streaming import rounds

    monkeypatch.setattr(rounds, "LAYERS", 2)
    (tmp_path / "f").mkdir()
    snapshots = Snapshots(spark, f"file://{tmp_path}/index")
    for n in range(4):
        (tmp_path / f"f/{n}.txt").write_text(f"bestand {n}")
        found = files.files(spark, [str(tmp_path / "f")]).withColumn("source", F.lit("map"))
        assert run_round(snapshots, found)["added"] == 1
        assert run_round(snapshots, found)["skipped"] == n + 1
    assert snapshots.documents().count() == 4
    held = [h for _, h in snapshots.rounds()]
    assert held.count("nothing") == 4 and "full" in held
