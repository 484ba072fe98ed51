"""The engine against SQL over the driver's tables, test vectors and plain Python."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cloakwork.functions import checksums as C
from cloakwork.functions.quality import quality_score
from cloakwork.functions.tokens import document_salt, make_token, token_hmac
from cloakwork.operators import audit, detect, manifest, pages, redact, rehydrate, resolve, screen, vault
from cloakwork.operators.policy import Policy, decide
from cloakwork.operators.recover import repair
from cloakwork.plans import queries as Q
from cloakwork.plans.pipeline import process
from cloakwork.sources import files
from cloakwork.streaming.watch import watch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for name in TABLES:
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return out


def plain(frame):
    value = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted((tuple(map(value, r)) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, con, name):
    if name in ("audit_events", "manifest_verify"):
        pytest.skip("slow here; the driver compares it")
    expected, found = con.execute(Q.ORACLE_SQL[name]).df(), Q.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    assert plain(found.select(names).toPandas()) == plain(expected[names])


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize(("kind", "good", "bad"), [
    ("IT_CODICE_FISCALE", ["RSSMRA85T10A562S", "rssmra85t10a562s", "RSSMRA 85T10 A562S "], ["RSSMRA85T10A562T", "RSSMRA85T10A562", "RSSMRA85Z10A562S", "RSSMRA85T99A562S", "", "ABCDEF12C34H567I"]),
    ("IT_PARTITA_IVA", ["00743110157"], ["00743110158", "1234567890", "abcdefghijk", ""]),
    ("IBAN", ["IT60X0542811101000000123456", "IT60 X054 2811 1010 0000 0123 456", "DE89370400440532013000", "GB82WEST12345698765432"], ["IT60X0542811101000000123457", "IT60X05428", "XX00ABCDEFGHIJKLMNOP", ""]),
    ("CREDIT_CARD", ["4539578763621486", "4539 5787 6362 1486"], ["4539578763621487", "1234567812345678", "123", ""]),
    ("IT_TARGA", ["AB123CD", "ab123cd", "AB 123 CD"], ["AI123CD", "AO123CD", "AQ123CD", "AU123CD", "AB12CD"]),
    ("IT_TESSERA_SANITARIA", ["80380000000000000001"], ["12380000000000000001"]),
])
def test_validators(spark, kind, good, bad):
    rows = texts(spark, *good, *bad).select("doc_id", C.VALIDATORS[kind](F.col("text")).alias("ok")).collect()
    assert [r.ok for r in sorted(rows)] == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize("damaged", ["RSSMRA85T1OA562S", "RSSMRA85TIOA562S", "RSSMRA8ST10A562S", "RSSMRA85TlOA562S", "RS5MRA85T10A562S", "RSSMRAB5T10A562S"])
def test_repairs(damaged):
    assert repair(damaged, "IT_CODICE_FISCALE", False)[0] == "RSSMRA85T10A562S"


def test_what_cannot_be_repaired():
    for noise in ("ABCDEF12G34H567I", "XYZWQK99A88B123C", "1234567890ABCDEF", "AAAAAAAAAAAAAAAA", "RSSMRA85T10A562S", "RSSMRA85T10A562Z"):
        assert repair(noise, "IT_CODICE_FISCALE", False) is None
    assert repair("O0743110157", "IT_PARTITA_IVA", False)[0] == "00743110157"
    assert repair("RSSMRA85T10A562Z", "IT_CODICE_FISCALE", True)[2]
    assert repair("4539578763621487", "CREDIT_CARD", True) is None


def test_offsets_as_in_python(spark):
    rows = ["x 😀 a.b@example.org, 😀c@d.it e 10.0.0.1.", "nessuno", "", None, "mail: " + "é x@y.com " * 200]
    pattern = next(r.pattern for r in detect.RECOGNIZERS if r.entity_type == "EMAIL")
    got = sorted((r.doc_id, r.start, r.end, r.raw) for r in detect.candidates(texts(spark, *rows), ("EMAIL",)).collect())
    assert got == sorted((i, m.start(), m.end(), m[0]) for i, t in enumerate(rows) for m in re.finditer(pattern, t or "", re.ASCII))


def test_every_recognizer_finds_its_form(spark):
    found = {r.entity_type for r in screen.screen(texts(spark, *Q.FORMS)).collect()}
    assert found >= {"IT_CODICE_FISCALE", "IT_PARTITA_IVA", "IBAN", "CREDIT_CARD", "IT_TESSERA_SANITARIA", "IT_TARGA", "EMAIL", "PHONE", "IP_ADDRESS", "MAC_ADDRESS", "ADDRESS", "DATE", "DATE_OF_BIRTH"}


def test_no_overlap_is_left_and_greedy_choice(spark):
    spans = Q.table_spans(spark, SF)
    kept = resolve.resolve_overlaps(spans)
    assert resolve.overlap_pairs(kept).count() == 0 < resolve.overlap_pairs(spans).count()


def test_round_trip_and_leaks(spark):
    documents = texts(spark, *Q.FORMS)
    done = process(documents, master=b"k" * 32)
    tokens = done.tokens.collect()
    safe = {r.doc_id: r.safe_text for r in done.documents.collect()}
    for t in tokens:
        assert t.token in safe[t.doc_id] and t.original not in safe[t.doc_id].replace(t.token, "")
    back = rehydrate.rehydrate(done.documents.select("doc_id", F.col("safe_text").alias("response")), done.tokens).collect()
    assert all(r.coverage == 1.0 and not r.warnings for r in back)
    again = {r.doc_id: r.safe_text for r in process(documents.repartition(5), master=b"k" * 32).documents.collect()}
    other = {r.doc_id: r.safe_text for r in process(documents, master=b"o" * 32).documents.collect()}
    assert again == safe and other != safe


def test_unknown_tokens_and_strict(spark):
    tokens = spark.createDataFrame([(1, "⟦PER_ab12⟧", "Ada"), (1, "⟦EML_00ff⟧", "a@b.it")], "doc_id long, token string, original string")
    answers = spark.createDataFrame([(1, "[[ PER _ ab12 ]] wrote to ⟦TEL_9999⟧")], "doc_id long, response string")
    row = rehydrate.rehydrate(answers, tokens).first()
    assert row.text == "Ada wrote to ⟦TEL_9999⟧" and row.coverage == 0.5 and row.unknown == ["⟦TEL_9999⟧"]
    with pytest.raises(Exception, match="unknown tokens"):
        rehydrate.rehydrate(answers, tokens, strict=True).collect()


def test_tokens_are_hmacs(spark):
    row = spark.range(1).select(make_token(F.lit("A@B.it"), F.lit("EMAIL"), b"\1" * 32).alias("t"), document_salt(b"m" * 32, F.lit(5)).alias("salt"))
    row = row.withColumn("own", make_token(F.lit("A@B.it"), F.lit("EMAIL"), F.col("salt"))).first()
    assert row.t == f"⟦EML_{token_hmac(b'EMAIL' + bytes(1) + b'a@b.it', bytes([1]) * 32)[:4]}⟧"
    assert row.salt == token_hmac(b"5", b"m" * 32)
    assert row.own == f"⟦EML_{token_hmac(b'EMAIL' + bytes(1) + b'a@b.it', bytes.fromhex(row.salt))[:4]}⟧"


def test_colliding_values_get_different_tokens(spark):
    rows = spark.createDataFrame([(1, 10 * i, 10 * i + 5, f"user{i}@example.com", "EMAIL", 0.9, None, i) for i in range(300)], "doc_id long, start int, end int, text string, entity_type string, confidence double, corrected_text string, ord int")
    out = redact.replacements(rows, Policy(), bytes(32), token_length=2).collect()
    assert len({r.token for r in out}) == len({r.canonical for r in out}) == 300


def test_decisions(spark):
    documents = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    spans = spark.createDataFrame([(0, 0, 3, "GDPR_ART9_HEALTH", 0.9, 1), (1, 0, 3, "PERSON", 0.4, 1), (2, 0, 3, "EMAIL", 0.95, 1)], "doc_id long, start int, end int, entity_type string, confidence double, ord int")
    got = {r.doc_id: (r.decision, len(r.reasons)) for r in decide(documents, spans, Policy(), F.when(F.col("doc_id") == 3, 0.5).otherwise(0.9), F.col("doc_id") == 4).collect()}
    assert got == {0: ("block", 1), 1: ("review", 1), 2: ("allow", 0), 3: ("review", 1), 4: ("block", 1)}
    with pytest.raises(ValueError, match="unknown entity types"):
        Policy({"NOBODY": {"action": "keep"}})
    assert Policy().sha256 != Policy(profile="other").sha256


def test_quality_of_text(spark):
    rows = ["Il tribunale ha esaminato la domanda e la respinge con le spese.", "", "short", "l a p a r o l a d i v i s a i n l e t t e r e", "#~^ `¬ §§ ¶¶ ~~ ^^ §§ ¬¬ ~~"]
    got = [r.q for r in sorted(texts(spark, *rows).select("doc_id", quality_score(F.col("text")).alias("q")).collect())]
    assert got[0] > 0.8 and got[1] == 0 and got[2] == 0.35 and got[3] < 0.75 and got[4] < 0.75


def test_native_text_is_cleaned(spark):
    rows = ["<latexit sha=1>abc</latexit>x", "26666666664 a", "f @x ✏", "w(t+1)  w(t)", "a\n\n\n\nb"]
    got = [r.t for r in sorted(texts(spark, *rows).select("doc_id", pages.clean_native_text(F.col("text")).alias("t")).collect())]
    assert got == ["x", "2 a", "f ∂x ε", "w(t+1) ← w(t)", "a\n\nb"]


def log(spark, n=5):
    rows = spark.createDataFrame([("log", i, f"t{i}", "event", f'{{"doc_id":{i % 2}}}') for i in range(n)], "log_id string, ord long, timestamp string, event string, payload string")
    return audit.chain(rows)


def test_audit_finds_what_was_changed(spark):
    whole = log(spark).cache()
    ok = audit.verify(whole).first()
    assert ok.valid and ok.entries == 5
    edited = audit.verify(whole.withColumn("event", F.when(F.col("seq") == 2, "other").otherwise(F.col("event")))).first()
    assert (edited.valid, edited.broken_at, edited.reason) == (False, 2, "content")
    removed = audit.verify(whole.where("seq <> 3")).first()
    assert (removed.valid, removed.broken_at, removed.reason) == (False, 4, "sequence")
    assert audit.for_document(whole, "1").count() == 2 and audit.tail(whole, 2).count() == 2
    more = audit.chain(spark.createDataFrame([("log", 9, "t9", "event", "{}")], "log_id string, ord long, timestamp string, event string, payload string"), audit.heads(whole))
    assert audit.verify(whole.unionByName(more)).first().entries == 6


def test_vault(spark):
    tokens = spark.createDataFrame([(1, "⟦PER_ab12⟧", "Ada Lovelace"), (2, "⟦PER_ffff⟧", "Alan")], "doc_id long, token string, original string")
    keys = vault.data_keys(tokens, b"k" * 32)
    sealed = vault.store(tokens, keys, b"k" * 32, F.lit("2024-01-01").cast("timestamp")).cache()
    assert sorted(vault.load(sealed, keys, b"k" * 32).collect()) == sorted(tokens.collect())
    assert all(b"Lovelace" not in bytes(r.ciphertext) for r in sealed.collect())
    assert vault.load(sealed, keys, b"x" * 32).count() == 0
    left = vault.forget(keys, spark.createDataFrame([(1,)], "doc_id long"))
    assert [r.doc_id for r in vault.load(sealed, left, b"k" * 32).collect()] == [2]
    assert vault.purge_expired(sealed, F.lit("2024-06-01").cast("timestamp")).count() == 2
    again = vault.data_keys(tokens, b"k" * 32)  # whoever holds the master key cannot make the forgotten key again
    assert vault.load(sealed, again, b"k" * 32).count() == 0


def test_manifests_and_markdown(spark):
    policy = Policy()
    done = process(texts(spark, Q.FORMS[1], "niente"), policy, salt=bytes(32), ner=screen.gazetteer({"niente": "GDPR_ART9_HEALTH"}))
    signed = done.manifests(policy, b"k").cache()
    assert all(r.valid for r in manifest.verify(signed, b"k").collect())
    changed = signed.withColumn("canonical", F.regexp_replace("canonical", "egress", "EGRESS"))
    assert {r.reason for r in manifest.verify(changed, b"k").collect()} == {"content"}
    pages_ = {r.doc_id: r for r in done.rendered(policy).collect()}
    assert pages_[1].decision == "block" and "niente" not in pages_[1].markdown
    assert "Example.com" not in pages_[0].markdown and "| E-mail address | 1 |" in pages_[0].markdown


def test_sources_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(Q.FORMS[0])
    (folder / "b.md").write_text("nothing here\nat all")
    read = {r.source_name: r.text for r in files.read_texts(spark, str(folder)).collect()}
    assert read == {"a.txt": Q.FORMS[0], "b.md": "nothing here\nat all"}
    found = files.read_pages(spark, str(folder), lambda data: data.decode().split("\n") if b"nothing" in data else 1 / 0).collect()
    assert sorted((r["index"], r.text) for r in found if r.error is None) == [(0, "nothing here"), (1, "at all")]
    assert sum(r.error is not None for r in found) == 1
    watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "audit"), str(tmp_path / "cp"), master=b"m" * 32, once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert audit.verify(files.read_audit(spark, str(tmp_path / "audit" / "batch=0"))).first().entries == 6
    settings = tmp_path / "config.env"
    settings.write_text("# x\nNER_BACKEND=gazetteer\nSEALED=false\nTEXT_THRESHOLD=10\n")
    assert files.read_settings((str(settings),)) == files.Settings(ner_backend="gazetteer", sealed=False, text_threshold=10)


def test_page_files_from_bytes_to_manifest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = "\f".join([Q.FORMS[0] + " The applicant lives in the town named above and signs this form today.", "  ", "�" * 80 + " x"])
    contents = {"good.pdf": good, "broken.pdf": "damaged", "empty.pdf": "%"}
    for name, content in contents.items():
        (folder / name).write_text(content)

    def reader(data):
        text = data.decode()
        if text == "damaged":
            raise ValueError("not a document")
        return [] if text == "%" else text.split("\f")

    found = pages.documents_of(files.read_pages(spark, str(folder), reader)).cache()
    rows = {r.source_name: r for r in found.collect()}
    assert {n: (r.pages, r.detection_error) for n, r in rows.items()} == {"good.pdf": (3, None), "broken.pdf": (0, "not a document"), "empty.pdf": (0, "no pages")}
    assert rows["good.pdf"].pages_below == [2, 3] and 0 < rows["good.pdf"].quality < 1
    first, last = rows["good.pdf"].text.split(pages.SEPARATOR)
    assert first.endswith("signs this form today.") and last.endswith("x")
    done = process(found, master=b"m" * 32, quality=F.col("quality"))
    out = {r.source_name: r for r in done.documents.collect()}
    assert {n: r.source_sha256 for n, r in out.items()} == {n: hashlib.sha256(c.encode()).hexdigest() for n, c in contents.items()}
    assert out["broken.pdf"].decision == out["empty.pdf"].decision == "block"
    assert any("2, 3" in w for w in out["good.pdf"].warnings)
    signed = done.manifests(Policy(), b"k" * 32)
    assert manifest.verify(signed, b"k" * 32).where("valid").count() == 3
    found.unpersist()


def test_whole_pages_are_classified(spark, tmp_path):
    rows = [(1, 0, "x" * 50), (1, 1, "  " + "word " * 40), (1, 5, "short"), (1, 2, "f(x) = 2"), (1, 3, " " * 80 + "a picture"), (1, 4, None), (1, 45, "y" * 49), (1, 50, " " * 45 + "z" * 50)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.task for r in Q.QUERIES["classify_pages"](spark, str(tmp_path)).collect()}
    assert got == {0: "text", 1: "text", 5: "table", 2: "formula", 3: "visual", 4: "visual", 45: "table", 50: "text"}


CONTEXTS = {
    "refine_dob": ("entity_type", detect.BIRTH, True, "DATE_OF_BIRTH", "DATE", {"10/12/1985": "DATE_OF_BIRTH", "01-02-1990": "DATE_OF_BIRTH", "2021-03-04": "DATE"}),
    "context_boost": ("confidence", detect.RECOGNIZERS[7].context, False, 0.85, 0.6, {"+39 348 1234567": 0.85, "3481234567": 0.85}),
    "recovery_context": ("supported", ("codice fiscale", "cod. fiscale", "cod.fiscale", "cod. fisc", "c.f.", "cf ", "cf:", "codfisc"), False, True, False, {"RSSMRA85T1OA562S": True, "RSSMRA8ST10A562S": True, "ABCDEF12G34H567I": False}),
}


@pytest.mark.parametrize("name", sorted(CONTEXTS))
def test_context_of_every_candidate(spark, tmp_path, name):
    column, words, left_only, yes, no, known = CONTEXTS[name]
    far = "nato il, telefono, codice fiscale " + "x " * 60  # words out of a candidate's reach
    bodies = ["", None, far, "nato il 03/04/1971. tel. 348 7654321; codice fiscale RSSMRA85T10A562S. " + "y " * 90 + "09/08/2007, 3487654321, RSSMRA85T10A562S " + "z " * 90]
    rows = [(8 * k + d, body) for k, body in enumerate(bodies) for d in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = {d: (body or "") + "\n" + Q.FORMS[d % 8] for d, body in rows}
    got = Q.QUERIES[name](spark, str(tmp_path)).collect()
    for r in got:
        text = whole[r.doc_id]
        assert text[r.start : r.end] == r.raw
        left, right = text[max(r.start - 60, 0) : r.start].lower(), text[r.end : r.end + 60].lower()
        around = left if left_only else f"{left} {right}"
        assert r[column] == (yes if any(w in around for w in words) else no)
    for raw, value in known.items():
        docs = {d for d, t in whole.items() if raw in t}
        assert docs and docs <= {r.doc_id for r in got if raw in r.raw}
        assert all(r[column] == value for r in got if raw in r.raw and r.doc_id < 8)
    assert {r[column] for r in got if r.doc_id >= 24 and r.start < 100} >= {yes} and {r[column] for r in got if r.doc_id >= 24 and r.start > 200} >= {no}


def test_short_master_keys_are_refused(spark):
    with pytest.raises(ValueError, match="32 bytes"):
        process(texts(spark, "x"), master=b"short")


def test_command_line(spark, tmp_path, capsys):
    from cloakwork.cli import main

    source, state, output = tmp_path / "in", str(tmp_path / "state"), tmp_path / "out"
    source.mkdir()
    (source / "letter one.txt").write_text("Scrivere a ada.lovelace@example.org, codice fiscale RSSMRA85T10A562S, oggi stesso per cortesia.", encoding="utf-8")
    assert main(["ingest", str(source), "--state", state, "--output", str(output)], spark) in (0, 2)
    doc_id = capsys.readouterr().out.split()[0]
    made = list(output.rglob("*.safe.md"))
    assert len(made) == 1 and made[0].name.startswith("letter_one.")
    safe = made[0].read_text(encoding="utf-8")
    assert "lovelace" not in safe
    assert main(["rehydrate", doc_id, str(made[0]), "--state", state], spark) == 0
    assert "ada.lovelace@example.org" in capsys.readouterr().out
    assert main(["verify", "--state", state], spark) == 0
    assert main(["audit", "--verify", "--state", state], spark) == 0
    assert main(["forget", doc_id, "--state", state], spark) == 0
    assert main(["rehydrate", doc_id, str(made[0]), "--state", state], spark) == 1
    assert main(["audit", "--verify", "--state", state], spark) == 0
    assert main(["forget", doc_id, "--state", state], spark) == 1
    assert main(["prompt"]) == 0
    capsys.readouterr()
    main(["scan", "--text", "write to a.b@example.org"], spark)
    assert "EMAIL" in capsys.readouterr().out


def test_entry_point_without_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    check = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'screen_spans' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    for gone in (False, True):
        if gone:
            (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", check], cwd=tmp_path / "copy", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})


def test_colliding_tokens_grow(spark):
    """Tokens of one hex digit do collide; each value of a document still has its own."""
    rows = [(1, 10 * i, 10 * i + 5, "EMAIL", f"a{i}@b.it", "regex", 0.9) for i in range(40)]
    spans = Q.table_spans(spark, SF).limit(0).unionByName(spark.createDataFrame(rows, 'doc_id long, start int, `end` int, entity_type string, text string, layer string, confidence double'), allowMissingColumns=True)
    got = redact.replacements(spans, Q.POLICY, Q.SALT, token_length=1).select("canonical", "token").distinct().collect()
    assert len(got) == len({r.token for r in got}) == 40


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_tokens_need_one_exchange(spark):
    """However many lengths a token may have, spans are dealt out by document once; the last value of equal beginnings keeps the short token."""
    assert exchanges(Q.QUERIES["token_collision"](spark, SF)) == 1
    spans = spark.createDataFrame([(1, at, at + 5, f"a{at // 3}@b.it", "EMAIL", None) for at in range(120)], "doc_id long, start int, end int, text string, entity_type string, corrected_text string")
    got = {r.text: (r.token, r.canonical) for r in redact.replacements(spans, Policy(), bytes(32), token_length=1).collect()}
    last = {}
    for at in range(120):
        text = f"a{at // 3}@b.it"
        last[token_hmac(b"EMAIL\0" + text.encode(), bytes(32))] = (at, text)
    for digest, (at, text) in last.items():
        free = (n for n in range(1, 17, 2) if all(d[:n] != digest[:n] or place < at for d, (place, _) in last.items() if d != digest))
        assert got[text] == (f"⟦EML_{digest[:next(free)]}⟧", text)


def test_detectors_take_separators_as_sql_does(spark, tmp_path):
    values = {"card": "4539578763621486", "ip": "10.0.0.1", "piva": "00743110157", "iban": "DE89370400440532013000", "ts": "80380000000000000001", "targa": "AB123CD", "phone": "348-123-4567", "mac": "00:1A:2B:3C:4D:5E", "date": "10/12/1985"}
    rows = [f"{lead}{sep.join([v] * 4)}{sep}" for v in values.values() for sep in (" ", ", ", ".", ". ", ";", "\n", "😀") for lead in ("", " ", "è ")]
    rows += [f"tel 555-3296 {values['card']} 53.1.2.3", f"12345678901234567890 {values['card']}", "1 2 3", None, ""]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("detect_card", "detect_ipv4", *(row[0] for row in Q._DETECTORS if row[0] != "detect_address")):
        assert plain(Q.QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(db.execute(Q.ORACLE_SQL[name]).df()), name
    # Screening finds what SQL leaves out.
    assert detect.spans_of(detect.candidates(texts(spark, "10.0.0.1 10.0.0.2 10.0.0.3"), ("IP_ADDRESS",))).count() == 3


def test_windows_lose_no_match(spark):
    """Long runs of plain words are cut before recognizers read a text; with MARK in it, a text is read whole."""
    import random

    from cloakwork.functions.strings import MARK, windows

    rng = random.Random(5)
    words = "via Roma della stessa casa , e poi il vicolo dei Rossi n. parola Città “così” | a ABCDEFGHIJKLMNOP abcdefghijklmnopqrstu über x\u00a0y 😀".split(" ")
    values = [form.split(": ")[-1] for form in Q.FORMS] + ["IT60" + " X" * 30, "via " + "Casa " * 5 + ", n. 12", "AB 123 CD", "a@b.it", "AA:BB:CC:DD:EE:FF", "5\u3000marzo 2020", "IT 00743110157", "9"]
    rows = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += [rng.choice(words) for _ in range(rng.choice((0, 3, 40, 120)))] + ["plain words"] * rng.choice((0, 30, 60)) + [rng.choice(values)]
        rows.append(rng.choice((" ", " ", "\n", "  ")).join(parts))
    documents = texts(spark, *rows, None, "")
    assert documents.select(windows(F.col("text"))["text"].alias("w")).where(F.instr("w", MARK) > 0).count() > 50
    found = lambda d: sorted(tuple(r)[:6] for r in detect.candidates(d).collect())
    whole = documents.withColumn("text", F.concat("text", F.lit(f" {MARK}")))
    assert found(documents) == found(whole) and len(found(documents)) > 300


def test_time_of_detection_on_plain_words(spark):
    """What recognizers read of a long text without identifiers does not grow with it."""
    from cloakwork.functions.strings import windows

    row = texts(spark, "plain words " * 20_000 + "a@b.it").select(windows(F.col("text")).alias("w")).first().w
    assert len(row.text) < 300 and row.at[0] + row.by[0] > 239_000


def test_screen_stats_detect_once(spark):
    documents = texts(spark, *Q.FORMS, None)
    stats = screen.screen_stats(documents)
    assert "regexp_extract_all" not in stats._jdf.queryExecution().executedPlan().toString()
    assert stats.first().unvalidated == detect.unvalidated(detect.candidates(documents)).count() > 0


@pytest.mark.parametrize("name", ["recover_phase1", "recover_phase2", "recover_spans"])
def test_recovery_runs_its_own_recognizers_only(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "gennaio" not in plan


def test_quality_joins_words_once(spark):
    plan = texts(spark, "x").select(quality_score(F.col("text")).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_join") == 1
