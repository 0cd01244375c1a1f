"""Rules as a table, arrays split over tasks, pages as a data source, the command line."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lexgrove.__main__ import main
from lexgrove.functions import question as Q
from lexgrove.operators import expansion, index, search
from lexgrove.sources import fetch
from lexgrove.sources import passages as P

ASKED = ["data breach presso il Garante", "L'autorità garante: stati  uniti, USA", "niente", "", None, "privacy privacy dpo", "extra UE e paese terzo", "garantea via"]


def test_rules_as_a_table_equal_the_chain(spark):
    asked = spark.createDataFrame(list(enumerate(ASKED)), "qid long, d string")
    want = {r.qid: r.x for r in asked.select("qid", Q.expand(F.col("d")).alias("x")).collect()}
    assert {r.qid: r.expanded for r in expansion.expanded(asked, expansion.builtin(spark)).collect()} == want
    twice = spark.createDataFrame([(1, "dpo"), (1, "usa"), (1, "usa"), (2, None)], "qid long, d string")
    assert sorted(r.expanded for r in expansion.expanded(twice, expansion.builtin(spark)).collect()) == ["", "dpo responsabile della protezione dei dati", "usa trasferimento paese terzo", "usa trasferimento paese terzo"]
    none = expansion.builtin(spark).limit(0)
    assert {r.expanded for r in expansion.expanded(asked.where("qid = 0"), none).collect()} == {"data breach presso il garante"}
    assert expansion.expanded(asked.limit(0), expansion.builtin(spark)).count() == 0


@pytest.mark.parametrize("bound", [100_000, 0])
def test_ten_thousand_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(expansion, "BROADCAST_RULES", bound)
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randint(0, 3000))
    rules = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3]))), f"m{k}") for k in range(10_000)] + [(5, "w1", "m5"), (None, "w1", "x"), (7, None, "x"), (8, "", "x")]
    asked = [(q, " ".join(word() for _ in range(40))) for q in range(50)] + [(q, "w1 w2") for q in range(50, 400)]
    out = expansion.expanded(spark.createDataFrame(asked, "qid long, d string"), spark.createDataFrame(rules, "rule long, trigger string, more string"))
    got = {r.qid: r.expanded for r in out.collect()}
    for q, d in asked:
        hit = {(k, m) for k, t, m in rules if k is not None and t and f" {t} " in f" {d} "}
        assert got[q] == " ".join([d, *(m for _, m in sorted(hit))])


def test_search_with_rules(spark, tmp_path):
    docs = spark.createDataFrame([(1, "titolo\nuna frase su cani e altro ancora", "src9"), (2, "titolo\nuna frase su gatti e altro ancora", "src9")], "doc_id long, text string, source string")
    ix = index.save(index.build(P.from_documents(docs)), str(tmp_path / "ix"))
    asked = spark.createDataFrame([(1, "felini")], "qid long, d string")
    rules = spark.createDataFrame([(1, "felini", "gatti")], "rule long, trigger string, more string")
    assert search.search(asked, ix).count() == 0
    assert [r.n for r in search.search(asked, ix, rules=rules).collect()] == [2]


def _objects(n):
    rng = random.Random(n)
    odd = ['}', '{', '"', '\\', '}"', '\\"}', '[{', "\n", "è", "", '{"a": "}"}', "\\\\}"]
    return [{"id": f"a{k}", "tipo": "articolo", "n": k, "par": None if k % 3 else k, "citazione": "".join(rng.choices(odd, k=3)), "rubrica": "", "termine": None, "capo": "", "testo": "".join(rng.choices(odd, k=rng.choice([0, 1, 9, 400])))} for k in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_array_is_read_by_many_tasks(spark, tmp_path, indent):
    first, second = _objects(700), _objects(40)
    (tmp_path / "a.json").write_text(json.dumps(first, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(second, indent=indent) + "\n", encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = P.read_json(spark, str(tmp_path), array=True).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.pos for r in rows] == list(range(740))
    assert [r.asDict() | {"pos": None} for r in rows] == [o | {"pos": None} for o in first + second]


def test_array_with_nested_objects_and_an_object_without_end(spark, tmp_path):
    (tmp_path / "a.json").write_text('[ {"id": "x", "more": {"b": {"c": "}"}, "d": [{}, {}]}}, null, 3, {"id": "y"} ]')
    assert [(r.pos, json.loads(r.element)["id"]) for r in P.array_elements(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "b.json").write_text('[{"id": "x"}, {"id": "y"')
    with pytest.raises(Exception):
        P.read_json(spark, str(tmp_path / "b.json"), array=True).collect()


class _Site(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        _Site.asked.append(self.path)
        body = f"pagina è {self.path}".encode()
        code = {"/304": 304, "/500": 500}.get(self.path, 200)
        self.send_response(code)
        self.send_header("Content-Length", str(len(body) + (50 if self.path == "/cut" else 0)) if code == 200 else "0")
        self.end_headers()
        if code == 200:
            self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_pages_as_a_source(spark, tmp_path):
    site = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{site.server_port}"
        read = lambda *paths, **more: fetch.pages(spark, [at + p for p in paths], str(tmp_path / "kept"), **more)
        want = {f"{at}/{k}": f"pagina è /{k}" for k in "abc"}
        assert read("/a", "/b", "/c").rdd.getNumPartitions() == 3
        assert {r.url: r.text for r in read("/a", "/b", "/c").collect()} == want
        before = len(_Site.asked)
        assert {r.url: r.text for r in read("/a", "/b", "/c").collect()} == want and len(_Site.asked) == before
        read("/a", force=True).collect()
        assert len(_Site.asked) > before
        for bad in ("/304", "/500", "/cut"):
            kept = sorted(p.name for p in (tmp_path / "kept").iterdir())
            with pytest.raises(Exception):
                read(bad).collect()
            assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == kept
        assert read().count() == 0
    finally:
        site.shutdown()


def test_command_line(spark, tmp_path, capsys):
    docs = [{"id": f"a{k}", "tipo": "articolo", "n": k, "par": None, "citazione": f"Articolo {k}", "rubrica": r, "termine": None, "capo": "", "testo": f"questo articolo tratta di {r} e di altro"} for k, r in enumerate(["cani", "gatti", "pesci"], 1)]
    (tmp_path / "d.json").write_text(json.dumps(docs))
    good = {"domande": [{"d": r["rubrica"], "attesi": [r["id"]]} for r in docs]}
    bad = {"domande": [{"d": "cani", "attesi": ["a3"]}, {"d": "gatti", "attesi": ["zz"]}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    ix, plain = str(tmp_path / "ix"), str(tmp_path / "plain")
    run = lambda *words: main([str(w) for w in words], spark)
    assert run("build", tmp_path / "d.json", ix, "--array") == 0 and run("build", tmp_path / "d.json", plain, "--array", "--plain") == 0
    capsys.readouterr()
    assert run("search", ix, "gatti") == 0 and capsys.readouterr().out.startswith("1\t1\tArticolo 2\t")
    assert run("evaluate", ix, tmp_path / "good.json", "--floors", "--details", "--plain", plain) == 0
    assert "P@1 100 %" in capsys.readouterr().out
    assert run("evaluate", ix, tmp_path / "bad.json", "--floors") == 1
    assert run("check", ix, tmp_path / "good.json") == 0 and run("check", ix, tmp_path / "bad.json") == 1
    assert "unknown\tzz" in capsys.readouterr().out
    assert run("sizes", ix) == 0 and run("publish", ix, tmp_path / "out") == 0
    assert run("publish", tmp_path / "nowhere", tmp_path / "out") == 1
