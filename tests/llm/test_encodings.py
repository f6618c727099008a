from pyspark.sql import functions as F

from weftline.llm import encodings as E

SENTENCES = {
    "fr": ["Le fichier généré contient des caractères inattendus.", "J'ai déplacé la vérification dans le module.", "Ça marche en local mais échoue ailleurs."],
    "de": ["Größere Aufträge dauern über sieben Sekunden.", "Außerdem heißt die Klasse jetzt anders.", "Die Änderung löst den Fehler nicht vollständig."],
    "uk": ["Зв'язок між задачею та комітом не знайдено.", "Після оновлення до версії зникають рядки.", "Я не зміг відтворити це у версії."],
    "pl": ["Należy też zmienić ustawienia.", "Błąd występuje, gdy słownik jest pusty.", "Usunięto zbędną zależność od modułu."],
    "ja": ["検索の設定は変更できます。", "テストを追加しました。", "この問題はまだ再現できていません。"],
    "es": ["El tamaño de la mañana no es válido.", "Todavía no sé cuál es la causa."],
    "en": ["The café demo (§12) uses “quotes” – see below…", "Nothing but ASCII here.", "Costs went from €17 to €16 per run."],
}


def damage(s, true, wrong):
    raw, out = s.encode(true), []
    for b in raw:
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def test_undo_is_the_inverse():
    for text in SENTENCES["fr"] + SENTENCES["pl"] + SENTENCES["uk"]:
        for wrong in ("cp1252", "cp1250", "cp437", "cp850", "mac_roman"):
            c = E._Chain("utf8", wrong, 1)
            assert "".join(c.undo(w) for w in [damage(text, "utf-8", wrong)]) == text, wrong
        twice = damage(damage(text, "utf-8", "cp1252"), "utf-8", "cp1252")
        assert E._Chain("utf8", "cp1252", 2).undo(twice) == text
    t = SENTENCES["uk"][1]
    assert E._Chain("koi8_u", "cp1251", 1).undo(damage(t, "koi8_u", "cp1251")) == t


def test_escapes():
    assert E.unescape("&#195;&#169; &eacute; &amp; \\u00e9 caf%C3%A9 \\u0041 &#65; 5%20") == "Ã© é &amp; é café \\u0041 &#65; 5%20"


def test_sentences_keep_the_text():
    for t in ("a. b\n\nc!  d", "\r\n x", "a.b.c", " ", "x:\ty\n", "…é; ü"):
        assert "".join(E.sentences(t)) == t


def test_repair(spark):
    rows, want = [], {}
    i = 0
    for _ in range(12):
        for s in SENTENCES.values():
            rows.append((i, " ".join(s), "git", "issue"))
            i += 1
    clean = i
    bad = [("fr", "utf-8", "cp1252"), ("de", "utf-8", "cp437"), ("pl", "utf-8", "cp1250"), ("uk", "cp1251", "cp1252"), ("uk", "koi8_u", "cp1251"), ("uk", "utf-8", "cp1252"), ("en", "utf-8", "mac_roman")]
    for lang, true, wrong in bad:
        for s in SENTENCES[lang]:
            if not s.isascii():
                rows.append((i, "Intro line.\n" + damage(s, true, wrong), None, "issue"))
                want[i] = "Intro line.\n" + s
                i += 1
    lost = i
    rows += [(i, "J\ufffdrn asked", "git", None), (i + 1, "tama&#195;&#177;o de la ma&#195;&#177;ana", "git", "issue"), (i + 2, "HTML shows &eacute;t&eacute; and caf%C3%A9", "git", "issue"), (i + 3, None, "git", "issue"), (i + 4, "", "git", "issue"), (i + 5, "x = √(a² + b²) · π", "git", "issue"), (i + 6, "Thanks, Roîriż!", None, None)]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, source string, kind string, damaged boolean")
    got = {r.doc_id: r for r in E.repair(df).collect()}
    assert len(got) == len(rows)
    for k in range(clean):
        assert not got[k].damaged and got[k].text == rows[k][1], got[k]
    found = [k for k in want if got[k].damaged]
    assert len(found) == len(want)
    assert sum(got[k].text == want[k] for k in want) >= 0.9 * len(want)
    assert got[lost].damaged and got[lost].text == "J\ufffdrn asked"
    assert got[lost + 1].damaged and got[lost + 1].text == "tamaño de la mañana"
    assert [got[lost + k].damaged for k in (2, 3, 4, 5, 6)] == [False] * 5 and got[lost + 3].text is None and got[lost + 4].text == ""
    assert E.repair(df.limit(0)).collect() == []


def test_restore_leaves_escapes_of_other_runs():
    c = E._Chain("utf8", "cp1252", 1)
    assert E.restore("GET /find?q=caf%C3%A9 &amp; tamaÃ±o ma&#195;&#177;ana &#65; \\u00e9t\\u00e9", c) == "GET /find?q=caf%C3%A9 &amp; tamaño mañana &#65; \\u00e9t\\u00e9"


def test_possible_chains_leave_none_out():
    words = [damage(w, "utf-8", x) for s in SENTENCES.values() for t in s for w in E.signature(t).split(" ") if w for x in ("cp1252", "cp437", "mac_roman")]
    words += [w for s in SENTENCES.values() for t in s for w in E.signature(t).split(" ") if w] + ["ROŸHÔR", "陆", "ÄãºÃ"]
    for w in words:
        assert {i for i, c in enumerate(E.chains()) if i and c.undo(w) != w} <= set(E._possible(w)), w


def test_names_without_other_evidence_stay(spark):
    # each could be two bytes of a character that stands nowhere else
    names = ["ROŸHÔR", "DUŐŞ", "NOÏDU", "BAZOÖŒ", "INTÔVR HEËŠ", "ØAÅU"]
    rows = [(i, f"Ticket of {n}, see below. {t}", f"s{i % 40}", "issue") for i, (n, t) in enumerate((n, t) for n in names for s in SENTENCES.values() for t in s)]
    rows += [(1000 + i, t, f"s{i % 40}", None) for i, t in enumerate(t for _ in range(9) for s in SENTENCES.values() for t in s)]
    bad = [(5000 + i, damage(t, "utf-8", "cp1252"), f"s{i % 40}", None) for i, t in enumerate(SENTENCES["fr"] + SENTENCES["de"])]
    got = {r.doc_id: r for r in E.repair(spark.createDataFrame(rows + bad, "doc_id long, text string, source string, kind string")).collect()}
    assert {k for k, r in got.items() if r.damaged} == {b[0] for b in bad}
    assert [got[b[0]].text for b in bad] == SENTENCES["fr"] + SENTENCES["de"]
