"""The pseudonymisation engine. Every identifier is fictional by construction."""

from __future__ import annotations

import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from veilwork.functions import keys, patterns, text, values
from veilwork.operators import codes, evaluation, fusion, model, references, reinjection, review, rules
from veilwork.plans import pipeline
from veilwork.sources import files

KEYS = [
    ("luhn", "4242 4242 4242 4242", True), ("luhn", "4242 4242 4242 4243", False), ("luhn", "0", False), ("luhn", None, False),
    ("siren", "120 027 016", True), ("siren", "120 027 017", False), ("siret", "120 027 016 00563", True), ("siret", "130 025 265 00013", True),
    ("siret", "35600000000005", False), ("siret", "35600000000006", True), ("siret", "1200270160056", False), ("card", "5555 5555 5555 4444", True), ("card", "4242 4242 42", False),
    ("iban", "ZZ43 0000 0000 0000 0000 0000 123", True), ("iban", "ZZ44 0000 0000 0000 0000 0000 123", False), ("iban", "ZZ43", False), ("iban", "", False),
    ("nir", "2 85 12 99 999 456 76", True), ("nir", "2 85 12 99 999 456 77", False), ("nir", "2851299", False),
    ("ip", "192.168.14.27", True), ("ip", "010.0.0.1", True), ("ip", "256.1.1.1", False), ("ip", "1.2.3", False),
]


def test_keys(spark):
    df = spark.createDataFrame(KEYS, "kind string, value string, valid boolean")
    got = F.lit(None).cast("boolean")
    for kind in {k for k, _, _ in KEYS}:
        got = F.when(F.col("kind") == kind, getattr(keys, kind)(F.col("value"))).otherwise(got)
    assert [r for r in df.withColumn("got", got).collect() if r.valid != r.got] == []


#: Each pattern alone: what it takes whole, and what it must not touch.
PATTERNS = [
    ("EMAIL", ["a.b+c@x-y.example.org"], ["a@b", "@x.org"]),
    ("IP", ["192.0.2.1"], ["1.2.3", "1.2.3.4.5"]),
    ("IBAN", ["ZZ43 0000 0000 0000 0000 0000 123", "ZZ430000"], ["Z430000", "AZZ430000"]),
    ("CARD", ["4242 4242-4242 4242"], ["4242  4242 4242 4242", "42424242424242424"]),
    ("NIR", ["2 85 05 2A 999 456 76", "285.05.99.999.456.76"], ["3 85 05 99 999 456 76", "2 85 05 99 999 456 7"]),
    ("SIREN", ["120 027 016", "120027016"], ["120  027 016", "1200270161"]),
    ("SIRET", ["120 027 016 00563"], ["120 027 016 0056"]),
    ("PHONE", ["06 39.98-01 02", "0639980102"], ["00 39 98 01 02", "+0639980102"]),
    ("PHONE_ABROAD", ["+44 20 7946 0000"], ["+44 123", "44 20 7946 0000"]),
    ("PLATE", ["AA-123-BB"], ["AA-1234-BB", "AAA-123-BB", "AA-123-BBB"]),
    ("DATE", ["1er mai 1980", "3 août 2001", "03/05/80", "3-5-1980"], ["32 foo 1980"]),
    ("POSTCODE", ["00100 Nullepart Cedex 9", "F-00100 Saint-Exemple", "00100 La Ville"], ["00100 ville", "001000 Ville"]),
    ("STREET_PARTICLE", ["de la ", "du ", "d'", "l’"], ["vers "]),
    ("STREET_NUMBER", ["12 bis", "7B", "1234"], ["bis"]),
    ("TYPED", ["AB12-2026-0001", "A/B/C"], ["AB-CD", "xA-B-C"]),
    ("BARE", ["55281", "123456789012"], ["5528", "1234567890123", "55281,5", "A-55281"]),
    ("DAMAGED_CODE", ["[EMAIL_001]", "[email 1]", "[Lieu-12]"], ["[1]", "[EMAIL]", "[EMAIL_]"]),
]


@pytest.mark.parametrize("name, whole, never", PATTERNS)
def test_patterns(name, whole, never):
    pattern = re.compile(getattr(patterns, name).replace("(?iu:", "(?i:"))
    for value in whole:
        m = pattern.search(f" {value} ")
        assert m and m[0].strip() == value.strip(), value
    for value in never:
        m = pattern.search(f" {value} ")
        assert not m or m[0] != value, value


CASES = [
    # text, spans as (category, text), flags
    ("", [], []),
    (None, [], []),
    ("Merci de votre accueil, à bientôt.", [], []),
    ("Écrire à zoe.test@example.org.", [("EMAIL", "zoe.test@example.org")], []),
    ("IBAN ZZ43 0000 0000 0000 0000 0000 123 ici", [("IBAN", "ZZ43 0000 0000 0000 0000 0000 123")], []),
    ("Appeler le 06 39 98 12 34 ou +33 6 39 98 56 78.", [("TELEPHONE", "06 39 98 12 34"), ("TELEPHONE", "+33 6 39 98 56 78")], []),
    ("Vu en 192.168.14.27. Version 1.2.3.4.5 non.", [("IP", "192.168.14.27")], []),
    ("Plaque AA-123-BB garée.", [("PLAQUE", "AA-123-BB")], []),
    ("Née le 3 Mars 1980, réunion le 4 mai 2026.", [("DATE_NAISSANCE", "3 Mars 1980")], []),
    ("Domicile F-00100 Le Nullepart CEDEX 3, suite", [("CODE_POSTAL_VILLE", "F-00100 Le Nullepart CEDEX 3")], []),
    ("Carte 4242 4242 4242 4242 ou 4242 4242 4242 4243", [("CARTE_BANCAIRE", "4242 4242 4242 4242")], []),
    ("12 bis, rue de l'Exemple\n00100 Nullepart", [("ADRESSE", "12 bis, rue de l'Exemple\n00100 Nullepart")], []),
    ("2e étage, rue barrée", [], []),
    ("Dossier n°58999 et dossier 58998.", [("IDENTIFIANT", "58999"), ("IDENTIFIANT", "58998")], []),
    ("Numéro n°58213 du dossier 999999", [("IDENTIFIANT", "58213"), ("IDENTIFIANT", "999999")], []),
    ("Contrat : 4 402 117. Facture de 3 200 € due.", [("IDENTIFIANT", "4 402 117")], []),
    ("Client 3e, année 2019", [("IDENTIFIANT", "2019")], []),
    ("Dossier traité par l'équipe en mars, 88317.", [], ["88317"]),
    ("Voici le dossier. 70418 visiteurs", [], ["70418"]),
    ("Vu AB12-2026-0033, pas AB-CD-EF.", [("IDENTIFIANT", "AB12-2026-0033")], []),
    ("L'arrêté n° 2024-0087, l'article L. 3142-1 et la loi nº 2021-1109.", [], []),
    ("Somme de 25000 € et 12345,67 puis 4418820.", [], ["4418820"]),
]


def test_analysis_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string").withColumn("spans", F.lit("clash")).drop("spans")
    done = pipeline.pseudonymise(df)
    for r in done.collect():
        _, spans, flags = CASES[r.doc_id]
        assert [(s.category, s.text) for s in r.spans] == spans, r.text
        assert [f.text for f in r.flags] == flags, r.text
        assert all((r.text or "")[s.start : s.end] == s.text for s in r.spans)
    back = reinjection.reinject(done.withColumn("reply", F.col("masked_text"))).collect()
    assert all(r.restored == (r.text or "") and r.no_problem for r in back)
    assert pipeline.pseudonymise(df.limit(0)).count() == 0


def test_analysis_against_a_plain_version(spark):
    """Random texts of values, near misses, triggers and addresses: spans, flags and masked text of the engine and of a plain walk."""
    from tests import plain

    bits = [
        "zoe@example.org", "a.b@x", "ZZ43 0000 0000 0000 0000 0000 123", "ZZ44 0000 0000 0000 0000 0000 123", "2 85 12 99 999 456 76", "2851299999456 77", "120 027 016 00563", "120027016",
        "35600000000006", "4242 4242 4242 4242", "4242424242424243", "06 39 98 01 02", "+44 20 7946 0000", "192.0.2.1", "300.1.1.1", "AA-123-BB", "né le 03/05/1980", "née le 1er mai 1980", "00100 Nullepart Cedex 2",
        "F-00100 Saint-Exemple", "12 bis rue de l'Exemple", "bâtiment B", "2e étage", "BP 12", "avenue", "Dossier n°", "dossier", "réf.", "Référence :", "5512", "QX-1234", "AB12-2026-0001", "7730021", "99812", "99812 €",
        "loi n°", "décret", "article L.", "2024-1200", "14/07/2026", "1ère", "12 345 678", "Zoé", "place", ".", ",", ";", "-", "(", "«", "",
    ]
    rng = random.Random(12)
    docs = [(i, "".join(x + rng.choice([" ", " ", " ", "\n", ", ", "  "]) for x in rng.choices(bits, k=rng.randint(1, 14)))) for i in range(600)]
    done = pipeline.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = 0
    for r in done:
        spans, flags = plain.analyse(r.text)
        assert [(s.start, s.end, s.category) for s in r.spans] == spans, r.text
        assert [(s.start, s.end, s.category) for s in r.flags] == flags, r.text
        assert r.masked_text == plain.mask(r.text, spans)
        found += len(spans)
    assert found > 1500


def test_text_with_the_mark_is_scanned(spark):
    df = spark.createDataFrame([(1, " a@example.org ")], "doc_id long, text string")
    assert [s.text for s in pipeline.analyse(df).first().spans] == ["a@example.org"]
    df = spark.createDataFrame([(1, "".join(text.MARKS) + " a@example.org \ue002 192.0.2.1")], "doc_id long, text string")
    assert [s.text for s in pipeline.analyse(df).first().spans] == ["a@example.org", "192.0.2.1"]


def _greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s["start"] - s["end"], -values.PRIORITY[s["source"]], -s["score"], s["start"])):
        if all(s["end"] <= k["start"] or k["end"] <= s["start"] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s["start"])


def test_fusion_is_the_greedy_choice(spark):
    rng, docs = random.Random(5), []
    for i in range(80):
        spans = [{"start": (a := rng.randrange(40)), "end": a + rng.randint(1, 12), "category": "X", "text": "", "source": rng.choice(list(values.PRIORITY)), "score": rng.choice([0.5, 0.9, 1.0])} for _ in range(rng.randint(0, 12))]
        docs.append((i, spans))
    df = spark.createDataFrame(docs, f"doc_id long, s {text.SPANS}")
    for r in df.withColumn("f", fusion.fuse(F.col("s"))).collect():
        want = _greedy([s.asDict() for s in r.s])
        assert [(s.start, s.end) for s in r.f] == [(s["start"], s["end"]) for s in want]


def test_same_entity():
    yes = [("Claire Durand", "Mme Durand"), ("C. Durand", "Claire Durand"), ("Durand Claire", "Claire Durand"), ("Pierre Durand", "Pierre Durant"), ("Société Exemple", "Societe EXEMPLE")]
    no = [("Pierre Fictif", "Pierre Marchand"), ("Monsieur", "Claire Durand"), ("Claire Durand", "Paul Martin")]
    assert all(codes.same_entity(*p) for p in yes)
    assert not any(codes.same_entity(*p) for p in no)
    assert round(codes.token_set_ratio(["pierre", "fictif"], ["pierre", "marchand"])) == 63
    assert codes.name_tokens("Cœur") == ["c", "ur"]


def test_codes_by_expression_equal_the_book(spark):
    rng, docs = random.Random(2), []
    for i in range(40):
        at, spans = 0, []
        for _ in range(rng.randint(0, 9)):
            cat = rng.choice(["EMAIL", "TELEPHONE", "IP", "LIEU"])
            val = rng.choice(["a@x.org", " A@X.org", "06 39 98", "06.39.98", "b  c", "b c"])
            spans.append((at, at + len(val), cat, val, "regle", 1.0))
            at += len(val)
        docs.append((i, spans))
    df = spark.createDataFrame(docs, f"doc_id long, spans {text.SPANS}")
    a = {r.doc_id: (r.codes, r.code_table) for r in codes.assign(df, names=False).collect()}
    b = {r.doc_id: (r.codes, r.code_table) for r in codes.assign(df, names=True).collect()}
    assert a == b


def test_numbering_is_by_first_appearance():
    """Against a plain walk: each value takes the first code with a value of its own category that is the same, or the next number."""
    rng = random.Random(5)
    pool = {"PERSONNE": ["Zoé Fictif", "ZOE  FICTIF", "Z. Fictif", "Ana Autre", "A. Autre", "Fictif"], "EMAIL": ["a@x.org", "A@x.org", "b@x.org"], "IP": ["192.0.2.1", "192.0.2.2"]}
    for _ in range(300):
        found = [(c, rng.choice(pool[c])) for c in rng.choices(list(pool), k=rng.randint(0, 9))]
        earlier = rng.choice([[], [{"code": "[PERSONNE_004]", "category": "PERSONNE", "values": ["Ana Autre"]}, {"code": "[IP_002]", "category": "IP", "values": ["192.0.2.2"]}]])
        table = [(e["code"], e["category"], list(e["values"])) for e in earlier]
        want = []
        for category, value in found:
            same = lambda v: codes.identity(category, v) == codes.identity(category, value) or category == "PERSONNE" and codes.same_entity(v, value)  # noqa: B023, E731
            exact = [c for c, k, vs in table if k == category and any(codes.identity(k, v) == codes.identity(k, value) for v in vs)]
            code = next(iter(exact), None) or next((c for c, k, vs in table if k == category and any(map(same, vs))), None)
            if code is None:
                code = f"[{category}_{max([int(c[-4:-1]) for c, k, _ in table if k == category], default=0) + 1:03d}]"
                table.append((code, category, []))
            entry = next(vs for c, _, vs in table if c == code)
            entry += [value] * (value not in entry)
            want.append(code)
        got, made = codes.number(found, earlier)
        assert got == want and sorted((e["code"], e["category"], e["values"]) for e in made) == sorted(table)


def test_names_propagate_and_merge(spark):
    doc = "Zoé Fictif arrive. Mme Fictif et Z. Fictif partent. Fictifs non. Marc Marchand reste."
    spans = [(0, 10, "PERSONNE", "Zoé Fictif", "modele", 0.9), (69, 82, "PERSONNE", "Marc Marchand", "modele", 0.8)]
    spans = [(a := doc.index(t), a + len(t), c, t, s, x) for _, _, c, t, s, x in spans]
    df = spark.createDataFrame([(1, doc, spans)], f"doc_id long, text string, model {text.SPANS}")
    r = pipeline.pseudonymise(df, model_col="model").first()
    assert r.masked_text == "[PERSONNE_001] arrive. Mme [PERSONNE_001] et Z. [PERSONNE_001] partent. Fictifs non. [PERSONNE_002] reste."


def test_reinjection_reports_what_is_odd(spark):
    table = [("[EMAIL_001]", "EMAIL", ["a@example.org", "aa@example.org"]), ("[IP_001]", "IP", ["192.0.2.1"])]
    rows = [(1, "Vu [email 1] et [IP_9]"), (2, None)]
    df = spark.createDataFrame([(*r, table) for r in rows], f"doc_id long, reply string, code_table {codes.TABLE}")
    one, two = reinjection.reinject(df).orderBy("doc_id").collect()
    assert one.restored == "Vu aa@example.org et [IP_9]" and one.n_replaced == 1 and not one.no_problem
    assert [(a.found, a.resolved) for a in one.to_check] == [("[email 1]", "[EMAIL_001]"), ("[IP_9]", None)]
    assert [a.found for a in one.unmentioned] == ["[EMAIL_001]", "[IP_001]"]
    assert two.restored == "" and two.no_problem and len(two.unmentioned) == 2


def _plain_fragments(doc, most):
    """Blocks of the coarsest kind that fit, long ones cut behind a space, neighbours joined while they fit."""
    for end in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+"):
        blocks = [b for b in re.sub(f"({end})", lambda m: m[0] + "\0", doc).split("\0") if b]
        if max(map(len, blocks)) <= most:
            break
    small = []
    for b in blocks:
        while len(b) > most:
            cut = b[:most].rfind(" ") + 1 or most
            small.append(b[:cut])
            b = b[cut:]
        small.append(b)
    out = [""]
    for b in small:
        if len(out[-1]) + len(b) <= most:
            out[-1] += b
        else:
            out.append(b)
    return out


@pytest.mark.parametrize("most", [20, 1000])
def test_fragments(most):
    rng = random.Random(1)
    for _ in range(200):
        doc = "".join(rng.choices(["mot ", "phrase. ", "\n", "\n\n", "x" * 30, "!"], k=rng.randint(0, 40)))
        parts = model.fragments(doc, most)
        assert "".join(p for _, p in parts) == doc
        assert all(len(p) <= most and doc[o : o + len(p)] == p for o, p in parts)
        if len(doc) > most:
            assert [p for _, p in parts] == _plain_fragments(doc, most)


def test_model_predictions_are_rebased(spark):
    def load():
        return lambda part, labels, threshold: [{"start": part.index("Zoé"), "end": part.index("Zoé") + 3, "label": "person", "text": "Zoé", "score": 0.9}] if "Zoé" in part else []

    doc = "mot " * 400 + "Zoé ici"
    docs = spark.createDataFrame([(1, doc), (2, None)], "doc_id long, text string")
    r = model.accept(docs, model.predict(docs, load)).collect()
    assert [(x.doc_id, x.spans[0].start) for x in r] == [(1, doc.index("Zoé"))]


def test_evaluation(spark):
    doc = "aa bbb cc bbb"
    spans = [(0, 2, "A", "aa", "regle", 1.0), (3, 5, "B", "bb", "regle", 1.0)]
    df = spark.createDataFrame([(1, doc, {"A": ["aa"], "B": ["bbb"]}, spans)], f"doc_id long, text string, directs map<string,array<string>>, spans {text.SPANS}")
    df = text.hold(df, expected=evaluation.expected(F.col("text"), F.col("directs")))
    scored, predicted = evaluation.score_expected(df), evaluation.score_predicted(df)
    assert [(r.start, r.masked, r.whole) for r in scored.orderBy("start").collect()] == [(0, True, True), (3, False, False), (10, False, False)]
    total = evaluation.report(scored, predicted).where("category IS NULL").first()
    assert (total.expected, total.masked, total.false_alarms, total.precision) == (3, 1, 0, 1.0)
    audit = evaluation.unannotated(spark.createDataFrame([(1, "vu 192.0.2.1", [])], f"doc_id long, text string, expected {evaluation.EXPECTED}")).collect()
    assert [(r.pattern, r.value) for r in audit] == [("ip", "192.0.2.1")]


def test_review(spark):
    df = spark.createDataFrame([(1, "Mail a@example.org, vu 4418820.", "vu", "LIEU")], "doc_id long, text string, w string, c string")
    done = review.to_review(pipeline.analyse(df))
    r = done.first()
    assert [x.checked for x in r.review] == [True, False]
    assert r.review[0].label == "EMAIL · « a@example.org » — format reconnu (position 5)"
    seg = done.withColumn("g", review.segments(F.col("text"), F.col("spans"))).first().g
    assert "".join(x.text for x in seg) == r.text
    added = review.add(done, "w", "c").first()
    assert [(s.category, s.text) for s in added.spans] == [("EMAIL", "a@example.org"), ("LIEU", "vu")]


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Bonjour") + f"<w:tbl><w:tr>{cell('a')}{cell('b@example.org')}</w:tr></w:tbl>" + p("Fin")
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "a.TXT").write_bytes(b"l1\r\nl2\rl3 \xff")
    (tmp_path / "b.rtf").write_bytes(b"x")
    (tmp_path / "c.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.TXT"].text == "l1\nl2\nl3 �"
    assert got["x.docx"].text == "Bonjour\nFin\na\tb@example.org"
    assert "rtf" in got["b.rtf"].error and got["b.rtf"].text is None
    assert got["c.docx"].error.startswith("illisible")
    assert files.pdf_text(b"", lambda _: ["  ", "x"])[0] is None
    assert files.pdf_text(b"", lambda _: ["a long page text", "another page text"])[0] == "a long page text\n\nanother page text"


def test_tables_and_cases(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@example.org 192.0.2.1")], "doc_id long, text string")
    files.write_tables(pipeline.pseudonymise(df), str(tmp_path / "t"), run="r1")
    back = files.read_tables(spark, str(tmp_path / "t")).first()
    assert [(e.code, e["values"]) for e in back.code_table] == [("[EMAIL_001]", ["a@example.org"]), ("[IP_001]", ["192.0.2.1"])]
    (tmp_path / "c.json").write_text(json.dumps({"annoncees": [{"id": "a", "phrase": "Dossier 5512", "references": ["5512"]}], "pieges": [{"id": "p", "phrase": "rien"}]}))
    cases = files.read_cases(spark, str(tmp_path / "c.json"))
    done = pipeline.analyse(cases.withColumn("text", F.col("phrase")))
    assert [(r.id, r.outcome) for r in evaluation.references(done).collect()] == [("a", "masked")]
    (tmp_path / "s.md").write_text("# t\n## Un\n```cas\n+ Dossier 5512 ici => 5512\n- Rien\\nla\n```\n")
    sheet = files.read_listed_cases(spark, str(tmp_path / "s.md")).collect()
    assert [(r.section, r.phrase, r.expected) for r in sheet] == [("Un", "Dossier 5512 ici", ["5512"]), ("Un", "Rien\nla", [])]


def test_command_line_keeps_documents_apart(spark, tmp_path, capsys):
    """Equal names in two folders, and endings that differ, are documents of their own; each reply gets its own values back."""
    from veilwork import cli

    docs = {"a/x.txt": "De un@example.org", "b/x.txt": "De deux@example.org", "b/x.md": "De trois@example.org et x.y+z é.txt", "b/blank.txt": " \n", "c d/é+%.txt": "De quatre@example.org"}
    for name, doc in docs.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(doc)
    (tmp_path / "in" / "bad.rtf").write_text("x")
    at = lambda name: str(tmp_path / name)
    assert cli.main(["mask", at("in"), at("out"), at("tables")]) == 0
    said = capsys.readouterr().out
    assert "EMAIL : 4" in said and "example.org" not in said
    masked = {p.relative_to(tmp_path / "out").as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert masked["a/x.txt.pseudonymise.txt"] == "De [EMAIL_001]" and len(masked) == 4 and not any("example" in m for m in masked.values())
    for name in masked:
        (tmp_path / "replies" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "replies" / name).write_text("Vu [EMAIL_001].")
    (tmp_path / "replies" / "a" / "broken.txt").write_bytes(b"\xff")
    (tmp_path / "replies" / "lone.txt").write_text("Vu [EMAIL_001].")
    # a later run over other texts must not be mixed in, and may be chosen or not
    run = next((tmp_path / "tables").glob("run=*")).name[4:]
    (tmp_path / "more" / "a").mkdir(parents=True)
    (tmp_path / "more" / "a" / "x.txt").write_text("De autre@example.org")
    assert cli.main(["mask", at("more"), at("out2"), at("tables"), "--run", "zzz"]) == 0
    capsys.readouterr()
    assert cli.main(["restore", at("replies"), at("tables"), at("back"), "--run", run]) == 0
    assert "4 remplaces" in (said := capsys.readouterr().out) and "1 illisibles, 1 sans table" in said
    back = {p.relative_to(tmp_path / "back").as_posix(): p.read_text() for p in (tmp_path / "back").rglob("*.txt")}
    assert back == {f"{n}.reinjecte.txt": f"Vu {d.split()[1]}." for n, d in docs.items() if d.strip()}
    assert cli.main(["restore", at("replies"), at("tables"), at("back2")]) == 0  # the latest run
    assert (tmp_path / "back2" / "a" / "x.txt.reinjecte.txt").read_text() == "Vu autre@example.org."
    twice = spark.createDataFrame([("k", "a@example.org"), ("k", "b@example.org")], "doc_id string, text string")
    files.write_tables(pipeline.pseudonymise(twice), at("tables"), run="zzzz")
    with pytest.raises(Exception, match="several code tables"):
        files.read_tables(spark, at("tables"), key_type="string").collect()


def test_command_line_evaluates(spark, tmp_path, capsys):
    from veilwork import cli

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("Ecrire à zoe.test@example.org, 06 39 98 01 02. Zoé Fictif habite 3 rue Exemple.")
    truth = {"documents": {"a.txt": {"directs": {"EMAIL": ["zoe.test@example.org"], "PERSONNE": ["Zoé Fictif"], "ADRESSE": ["habite 3 rue Exemple"]}, "indirects": []}}}
    (tmp_path / "truth.json").write_text(json.dumps(truth))
    at = lambda name: str(tmp_path / name)
    assert cli.main(["evaluate", at("t"), at("none.json")]) == 2
    assert cli.main(["evaluate", at("t"), at("truth.json"), "--false-alarms"]) == 1  # rules find no names
    said = capsys.readouterr().out
    assert "adresses partielles : 1" in said and "fausse alerte TELEPHONE : 1" in said and "noms de personnes : 0/1, non atteint" in said
    assert cli.main(["evaluate", at("t"), at("truth.json"), "--model", "tests.names:load"]) == 0
    assert "noms de personnes : 1/1, atteint" in capsys.readouterr().out


def test_model_is_part_of_the_analysis(spark):
    """Predictor, acceptance and analysis together, for documents of any kind of key, with and without findings."""
    from tests import names

    docs = spark.createDataFrame([("a", "Zoé Fictif écrit. Mme Fictif part."), ("b", "rien"), ("c", None)], "doc_id string, text string")
    done = pipeline.pseudonymise(pipeline.with_model(docs, names.load), model_col="model")
    got = {r.doc_id: r.masked_text for r in done.collect()}
    assert got == {"a": "[PERSONNE_001] écrit. Mme [PERSONNE_001] part.", "b": "rien", "c": ""}
    by = pipeline.by_category(pipeline.analyse(spark.createDataFrame([(1, "192.0.2.1 a@example.org 192.0.2.2")], "doc_id long, text string"))).collect()
    assert [(r.place, r.category, [s.text for s in r.spans]) for r in by] == [(0, "IP", ["192.0.2.1", "192.0.2.2"]), (1, "EMAIL", ["a@example.org"])]


def test_public_numbers_from_a_model(spark):
    doc = "Voir la loi n° 2016-1321 et l'article l. 3142."
    spans = [(a := doc.index(t), a + len(t), "IDENTIFIANT", t, "modele", 0.9) for t in ("loi n° 2016-1321", "3142")]
    df = spark.createDataFrame([(doc, spans)], f"t string, s {text.SPANS}")
    # a code prefix is a capital: what follows « l. » stays
    assert [x.text for x in df.select(references.drop_public(F.col("t"), F.col("s")).alias("k")).first().k] == ["3142"]


def test_public_numbers_whatever_the_blanks(spark):
    gap = " " * 45
    docs = [(f"Voir la loi{gap}n° 20161321 ici", []), ("Selon l'arrêté 12345 ici", []), (f"article{gap}L.{gap}12345", []), (f"dossier {gap}12345, vu la loi", ["12345"])]
    for doc, want in docs:
        found = [(m.start(), m.end(), "IDENTIFIANT", m[0], "regle", 1.0) for m in re.finditer(r"\d+", doc)]
        df = spark.createDataFrame([(doc, found)], f"t string, s {text.SPANS}")
        assert [x.text for x in df.select(references.drop_public(F.col("t"), F.col("s")).alias("k")).first().k] == want


def test_streams(spark, tmp_path):
    from veilwork.streaming import stream

    src = tmp_path / "in"
    spark.createDataFrame([("c", 1, "a@example.org"), ("c", 2, "b@example.org a@example.org")], "case_id string, doc_id long, text string").write.parquet(str(src))
    read = lambda: spark.readStream.schema("case_id string, doc_id long, text string").parquet(str(src))
    q = stream.pseudonymise_stream(read()).select("doc_id", "masked_text").writeStream.format("memory").queryName("plain").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: r.masked_text for r in spark.table("plain").collect()} == {1: "[EMAIL_001]", 2: "[EMAIL_001] [EMAIL_002]"}


def test_cases_keep_their_codes_across_batches(spark, tmp_path):
    from veilwork.streaming import stream

    src, kind = str(tmp_path / "in"), "case_id string, doc_id long, text string"
    spark.createDataFrame([("c", 1, "a@example.org"), ("d", 5, "x@example.org")], kind).coalesce(1).write.parquet(src)
    spark.createDataFrame([("c", 2, "b@example.org a@example.org")], kind).coalesce(1).write.mode("append").parquet(src)
    read = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.pseudonymise_cases(read).writeStream.format("memory").queryName("cases").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: r.masked_text for r in spark.table("cases").collect()}
    assert got[5] == "[EMAIL_001]"
    # which file comes first is the source's choice; the case's mail keeps its code either way
    tables = [r.code_table for r in spark.table("cases").collect() if r.case_id == "c"]
    last = max((t for t in tables if t), key=len)
    assert {(e.code, tuple(e["values"])) for e in last} in ({("[EMAIL_001]", ("a@example.org",)), ("[EMAIL_002]", ("b@example.org",))}, {("[EMAIL_002]", ("a@example.org",)), ("[EMAIL_001]", ("b@example.org",))})
    assert (got[1], got[2]) in (("[EMAIL_001]", "[EMAIL_002] [EMAIL_001]"), ("[EMAIL_002]", "[EMAIL_001] [EMAIL_002]"))


def test_review_keep_reviews_every_case(spark, tmp_path, monkeypatch):
    from veilwork.plans import catalog

    spark.range(1, 7).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name"), F.lit("1").alias("c_phone"), F.lit(0).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    seen, keep = [], review.keep
    monkeypatch.setattr(review, "keep", lambda *a: seen.append(keep(*a)) or seen[-1])
    done = catalog.queries()["review_keep"](spark, str(tmp_path))
    got = {r.doc_id: (r.n_kept, r.n_rejected, len(r.spans)) for r in seen[0].collect()}
    assert got == {k: (0, 11, 0) if k % 2 else (2, 10, 2) for k in range(1, 7)}
    assert sorted(r.doc_id for r in done.collect()) == [2, 4, 6]


def test_iban_of_letters_by_whole_numbers(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        body = "".join(rng.choices("0123456789ABCXYZ" if i % 2 else "0123456789", k=rng.choice([9, 10, 11, 20, 29, 30, 31])))
        key = 98 - int("".join(str(int(c, 36)) for c in body + "ZZ00")) % 97 + (i % 3 == 0)
        rows.append((i, f"zz{key % 100:02d} {body[:7]}-{body[7:]}", 11 <= len(body) <= 30 and int("".join(str(int(c, 36)) for c in f"{body}ZZ{key % 100:02d}")) % 97 == 1))
    got = spark.createDataFrame(rows, "i int, value string, want boolean").withColumn("got", keys.iban(F.col("value")))
    assert [r.i for r in got.collect() if r.got != r.want] == [] and sum(r[2] for r in rows) > 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "sequence" not in plan  # the value is cleaned once, not once a character


def test_a_scan_finds_the_mark_once_a_row(spark):
    from veilwork.plans import catalog

    plan = catalog.queries()["scan_keyed_orders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("every private-use character") == 1  # 36 times before, at each use in each rule


def test_short_keys_by_whole_numbers(spark):
    """Accounts of digits of every length and departments of Corsica against plain arithmetic; letters elsewhere are no key."""
    rng, rows = random.Random(5), [("nir", "2A0059900101" + "845", False), ("nir", "2850A1299999456", False)]
    for n in range(9, 33):
        account = "".join(rng.choice("0123456789") for _ in range(n))
        right = 98 - int(f"{account}{rng.choice(('3535', '1027'))}00") % 97
        for country in ("ZZ", "AR"):
            for check in (right, rng.randrange(100)):
                number = int(f"{account}{''.join(str(ord(c) - 55) for c in country)}{check:02d}")
                rows.append(("iban", f"{country}{check:02d}{account}", 11 <= n <= 30 and number % 97 == 1))
    for dep, plain in (("2A", "19"), ("2B", "18"), ("75", "75")):
        body = f"2{rng.randrange(100):02d}05{dep}{rng.randrange(10**6):06d}"
        key = 97 - int(body.replace(dep, plain)) % 97
        rows += [("nir", f"{body}{key:02d}", True), ("nir", f"{body}{key % 97 + 1:02d}", False), ("nir", f"{body}{key:02d}0", False)]
    assert sum(r[2] for r in rows) > 20
    got = F.when(F.col("kind") == "iban", keys.iban(F.col("value"))).otherwise(keys.nir(F.col("value")))
    assert [r for r in spark.createDataFrame(rows, "kind string, value string, valid boolean").withColumn("got", got).collect() if r.valid != r.got] == []


def test_hints_pass_what_their_patterns_take(spark):
    """The test in front of the postcodes took only 0 to 9, their pattern takes all digits."""
    texts = ["à ٧٥٠٠١ Paris", "le 75001  Le Mans CEDEX 09", "NÉE LE 3/4/1980", "Date De Naissance: 1er mai 1980", "né le 03.04.80"]
    found = text.hold(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), s=rules.scan(F.col("t"))).orderBy("i").collect()
    assert [[s.text for s in r.s] for r in found] == [["٧٥٠٠١ Paris"], ["75001  Le Mans CEDEX 09"], ["3/4/1980"], ["1er mai 1980"], ["03.04.80"]]
