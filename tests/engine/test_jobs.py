import csv
import glob
import json
import random
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from logmill.operators import kernels
from logmill.operators.order import dealt, numbered
from logmill.operators.summarize import summarize
from logmill.plans import job
from logmill.plans.spec import load_format
from logmill.sinks.write import fetch_all, post_lines, print_top
from logmill.sources.binary import grid_points, random_matrix, random_words, read_bitmaps, read_points
from logmill.sources.text import lines_from, lines_of_table, read_lines, stream_lines, tokens_of_table
from logmill.streaming.incremental import start_snapshots, start_to_table, summarize_stream, windowed_counts

FORMAT = {
    "format_name": "f",
    "delims": ",",
    "commentchar": "#",
    "fields": [
        {"name": "k", "pos": 0, "type": "string", "key": True},
        {"name": "v", "pos": 1, "type": "int", "aggregated": True, "aggregation": "sum"},
        {"name": "w", "pos": 2, "type": "string", "aggregated": True, "aggregation": "union_count"},
    ],
}


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text('k,v,w\na,1,x\n#c\n\nb,2,"y\nbad\na,3,x\n')
    (tmp_path / "in/b.log").write_text("k,v,w\r\na,4,z\r\n   \r\n")
    (tmp_path / "f.json").write_text(json.dumps(FORMAT))
    return tmp_path


def texts(folder):
    return sorted(line for f in glob.glob(f"{folder}/part-*") for line in open(f).read().splitlines())


def test_job_outputs(spark, logs, capsys):
    names = f"{logs}/in/a.log,{logs}/in/b.log"
    base = ["-fnames", names, "-format_name", f"{logs}/f.json", "-skip_header"]
    out = job.run(spark, job.parse_options([*base, "-output_format", "json", "-ofname", f"{logs}/j", "-merge_results"]))
    assert {r._key: r.v for r in out.collect()} == {"a": 8, "b": 2}
    got = [json.loads(x) for x in texts(f"{logs}/j")]
    assert got[0] == {"format_name": "f", "id": "a", "k": "a", "logs": 3, "std_date_dt": "0000-00-00T00:00:00Z", "v": 8, "w": ["x", "z"], "w_count": [2, 1]}
    assert "Number of keys: 2" in capsys.readouterr().out
    per_file = job.run(spark, job.parse_options([*base, "-output_format", "text", "-ofname", f"{logs}/t", "-quiet"]))
    assert texts(f"{logs}/t") == ["a - 1", "a - 2", "b - 1"] and per_file.count() == 3
    job.run(spark, job.parse_options([*base, "-output_format", "csv", "-ofname", f"{logs}/c", "-merge_results", "-tmp_save", "-quiet"]))
    rows = [r for f in glob.glob(f"{logs}/c/part-*") for r in csv.DictReader(open(f))]
    assert {r["id"]: (r["v"], r["w"], r["w_count"]) for r in rows} == {"a": ("8", "[x,z]", "[2,1]"), "b": ("2", "y", "1")}
    first = [r for f in glob.glob(f"{logs}/c-00001/part-*") for r in csv.DictReader(open(f))]
    assert {r["id"]: (r["v"], r["w"], r["w_count"]) for r in first} == {"a": ("4", "x", "2"), "b": ("2", "y", "1")}
    mem = job.run(spark, job.parse_options([*base, "-output_format", "mem", "-merge_results", "-quiet", "-appname", "app", "-store_content"]))
    assert {r._key: r._content for r in mem.collect()} == {"a_app": "a,1,x\na,3,x\na,4,z\n", "b_app": 'b,2,"y\n'}
    with pytest.raises(ValueError):
        job.run(spark, job.parse_options(base))
    assert job.launch("test $a = $b", {"a": "1", "b": "1"}) == 0 and job.launch("test $a = $b", {"a": "1", "b": "2 x"}) == 1


def test_split_invariance(spark, tmp_path):
    lines = [f"k{i % 7},{i},w{i % 3}" for i in range(3000)]
    (tmp_path / "big.log").write_text("\n".join(lines) + "\n")
    want = {r.id: (r.v, tuple(r.w_count), r.logs) for r in summarize(lines_from(spark, lines), load_format(FORMAT)).collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    source = read_lines(spark, str(tmp_path / "big.log"))
    assert source.rdd.getNumPartitions() > 3
    assert {r.id: (r.v, tuple(r.w_count), r.logs) for r in summarize(source, load_format(FORMAT)).collect()} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_table_sources(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, None, 6, "y")], "i int, k string, v int, w string")
    f = load_format({**FORMAT, "delims": "|", "keep_empty": True})
    by_lines = {(r.id, r.v) for r in summarize(lines_of_table(df, ["k", "v", "w"], "|"), f).collect()}
    assert by_lines == {("a", 5), ("", 6)} or by_lines == {("a", 5), (None, 6)}
    assert {r._key for r in summarize(tokens_of_table(df, ["k", "v", "w"]), load_format(FORMAT)).collect()} == {"a", ""}


def test_streams(spark, logs):
    f = load_format(FORMAT)
    q = start_to_table(summarize_stream(stream_lines(spark, f"{logs}/in", header=True, comment="#", max_files=1), f), "streamed", f"{logs}/ck")
    q.awaitTermination()
    assert {r._key: (r.v, r.w, r.w_count) for r in spark.table("streamed").collect()} == {"a": (8, ["x", "z"], [2, 1]), "b": (2, ["y"], [1])}
    start_snapshots(summarize_stream(stream_lines(spark, f"{logs}/in", True, "#", 1), f), f"{logs}/snap", f"{logs}/ck2").awaitTermination()
    assert len(glob.glob(f"{logs}/snap/*")) == 2
    assert windowed_counts(spark.sql("select timestamp'2020-01-01 00:00:01' t, 'a' k"), "t", "1 minute", "5 minutes", "k").count() == 1


def test_data_source(spark, logs):
    from logmill.sources.datasource import LogSource

    spark.dataSource.register(LogSource)
    for split in (1 << 20, 5):
        df = spark.read.format("logmill").options(format=json.dumps(FORMAT), header="true", split=str(split)).load(f"{logs}/in/a.log")
        assert sorted(map(tuple, df.collect())) == [("a", "1", "x"), ("a", "3", "x"), ("b", "2", "y")]


class Endpoint(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        Endpoint.seen += json.loads(body)
        self.send_response(500 if b"fail" in body else 200)
        self.end_headers()

    def do_GET(self):
        self.send_response(404 if "none" in self.path else 200)
        if "login" in self.path:
            self.send_header("Set-Cookie", "who=me")
        self.end_headers()
        self.wfile.write(" ".join(["hi", *(f"{k}={self.headers[k]}" for k in ("X-Tag", "Cookie") if self.headers[k])]).encode())

    def log_message(self, *a):
        pass


def test_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    lines = spark.createDataFrame([(json.dumps({"id": i}),) for i in range(25)], "value string").coalesce(1)
    assert tuple(post_lines(lines, url, batch=10).collect()[0]) == (3, 0) and len(Endpoint.seen) == 25
    bad = spark.createDataFrame([('{"fail": 1}',)], "value string")
    assert tuple(post_lines(bad, url, attempts=2).collect()[0]) == (0, 1)
    got = fetch_all(spark.createDataFrame([(url + "/a",), (url + "/none",), ("http://127.0.0.1:1/",)], "url string"), timeout=3)
    assert sorted((r.status, r.body) for r in got.collect()) == [(0, None), (200, "hi"), (404, None)]
    rows = spark.createDataFrame([(f"{url}/login", None), (f"{url}/b", {"X-Tag": "7"})], "url string, h map<string,string>").coalesce(1)
    assert [r.body for r in fetch_all(rows, headers="h", jar=True).collect()] == ["hi", "hi X-Tag=7 Cookie=who=me"]
    server.shutdown()


def test_kernels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b, A"), (2, "b Ç c"), (3, None)], "d int, text string")
    assert [tuple(r) for r in kernels.top_words(docs, 2).collect()] == [("A", 2), ("B", 2)]
    assert {(r.word, r.doc): r.positions for r in kernels.inverted_index(docs, "d").collect()} == {("A", 1): [0, 2], ("B", 1): [1], ("B", 2): [0], ("C", 2): [1]}
    twice = docs.unionByName(docs.where("d > 1"))
    assert {(r.word, r.doc): r.positions for r in kernels.inverted_index(twice, "d").collect()} == {("A", 1): [0, 2], ("B", 1): [1], ("B", 2): [0, 0], ("C", 2): [1, 1]}
    generated = random_words(spark, 1000)
    assert kernels.word_positions(generated, "doc").count() == 1000
    pixels = bytes([1, 2, 3, 1, 2, 4])
    (tmp_path / "x.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 60, 0, 0, 54) + b"\0" * 14 + struct.pack("<H", 24) + b"\0" * 24 + pixels)
    counts = {(r.channel, r.value): r.n for r in read_bitmaps(spark, str(tmp_path / "x.bmp")).collect()}
    assert counts == {("B", 1): 2, ("G", 2): 2, ("R", 3): 1, ("R", 4): 1}
    (tmp_path / "p.bin").write_bytes(struct.pack("<8b", 1, 3, 2, 5, 3, 7, -1, -1))
    r = kernels.linear_regression(read_points(spark, str(tmp_path / "p.bin"))).collect()[0]
    assert (r.n, r.sx, r.sxy) == (4, 5, 35) and r.a == pytest.approx(1) and r.b == pytest.approx(2) and r.r2 == pytest.approx(1)
    points = grid_points(spark, 50, 3, 10)
    means, assigned = kernels.kmeans(points, 4, integer=True)
    again = kernels.cluster_means(assigned, integer=True).collect()
    assert all(means[x.cluster][x.dim] == x["mean"] for x in again) and assigned.count() == 50
    a, b = random_matrix(spark, 4, 5, seed=1), random_matrix(spark, 5, 3, seed=2)
    cell = lambda m: {(x.i, x.j): x.v for x in m.collect()}
    ca, cb = cell(a), cell(b)
    assert cell(kernels.matrix_product(a, b)) == {(i, j): sum(ca[i, k] * cb[k, j] for k in range(5)) for i in range(4) for j in range(3)}
    mean = {i: int(sum(ca[i, k] for k in range(5)) / 5) for i in range(4)}
    want = {(i, j): int(sum((ca[i, k] - mean[i]) * (ca[j, k] - mean[j]) for k in range(5)) / 3) for i in range(4) for j in range(i, 4)}
    assert {(x.i, x.j): x.cov for x in kernels.row_covariance(a, integer=True).collect()} == want
    found = kernels.string_match(spark.createDataFrame([("ferrari",), ("x",), ("ferrari",), ("Howareyou",)], "word string"))
    assert {r.target: r.n for r in found.collect()} == {"Helloworld": 0, "howareyou": 0, "ferrari": 2, "whotheman": 0}


def test_print_top(spark):
    out = print_top(summarize(lines_from(spark, ["a,1,x", "a,1,x", "b,1,x"]), load_format(FORMAT)), 1)
    assert out.splitlines()[-1].split() == ["2", "a"] and "Number of logs: 3" in out


def test_kmeans_settles_or_says_so(spark):
    points = spark.createDataFrame([(i, [float(2**i)]) for i in range(12)], "id long, point array<double>")
    means, assigned = kernels.kmeans(points, 2)
    again = kernels.cluster_means(assigned).orderBy("cluster").collect()
    assert [[r["mean"]] for r in again] == means
    with pytest.raises(RuntimeError):
        kernels.kmeans(points, 2, most_rounds=1)


def test_kmeans_is_lloyds_algorithm(spark):
    """The whole iteration against a plain loop, over fractions."""
    rng = random.Random(4)
    points = [(i, [rng.gauss(3 * (i % 4), 1.0), rng.gauss(i % 4, 1.0)]) for i in range(300)]
    means = [list(p) for _, p in points[:4]]
    labels: list[int] = []
    while True:
        new = [min(range(4), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, means[c])), c)) for _, p in points]
        if new == labels:
            break
        labels = new
        for c in range(4):
            own = [p for (_, p), k in zip(points, labels) if k == c]
            if own:
                means[c] = [sum(v) / len(own) for v in zip(*own)]
    found, assigned = kernels.kmeans(spark.createDataFrame(points, "id long, point array<double>"), 4)
    assert [r.cluster for r in assigned.orderBy("id").collect()] == labels
    assert all(a == pytest.approx(b) for x, y in zip(found, means) for a, b in zip(x, y))


def test_kmeans_reads_its_points_once(spark):
    """However many rounds: the start, the number of points, the matrices, and the assigned points."""
    rng = random.Random(8)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(i, [rng.gauss(0.0, 1.0) for _ in range(5)]) for i in range(2000)]
    points = spark.createDataFrame(rows, "id long, point array<double>").mapInArrow(counted, "id long, point array<double>")
    with pytest.raises(RuntimeError):
        kernels.kmeans(points, 4, most_rounds=3)
    read.value = 0
    _, assigned = kernels.kmeans(points, 4)
    assert assigned.count() == 2000 and read.value <= 4 * 2000


def test_kmeans_leaves_out_points_without_a_place(spark):
    rows = [(0, [0.0, 0.0]), (1, [8.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [4.0]), (6, [8.0, 2.0]), (7, [4.0, 1.0])]
    means, assigned = kernels.kmeans(spark.createDataFrame(rows, "id long, point array<double>"), 2)
    assert {r.id: r.cluster for r in assigned.collect()} == {0: 0, 1: 1, 2: 0, 3: None, 4: None, 5: None, 6: 1, 7: 0}
    assert means == [[pytest.approx(4 / 3), 1.0], [8.0, 1.0]]


def test_rounds_assign_as_the_expression_does(spark):
    """Ties, equal means, numbers far from 0, very large ones and NaN."""
    import numpy as np

    rng = random.Random(2)
    means = [[float(rng.randrange(3)) for _ in range(3)] for _ in range(6)]
    rows = [[float(rng.randrange(-1, 4)) for _ in range(3)] for _ in range(400)]
    far = [[v + 1e8 for v in p] for p in means]
    odd = [[float("nan"), 0.0, 0.0], [1e200, 0.0, 0.0], [1e160, 1.0, 0.0], [float("inf"), 0.0, 0.0]]
    for ps, ms in ((rows, means), ([[v + 1e8 for v in p] for p in rows], far), (odd, means), (rows, [[1e200, 0.0, 0.0], [float("nan"), 0.0, 0.0], [-1e200, 0.0, 0.0]])):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "id long, point array<double>")
        want = [r.cluster for r in kernels.assign_nearest(df, ms).orderBy("id").collect()]
        assert kernels._nearest(np.array(ps), np.array(ms)).tolist() == want


def test_absent_cells_are_zeros(spark):
    cells = [(0, 0, 3.0), (0, 2, 4.0), (2, 1, 5.0)]
    full = [[3.0, 0.0, 4.0], [0.0, 0.0, 0.0], [0.0, 5.0, 0.0]]
    mean = [sum(r) / 3 for r in full]
    want = {(i, j): sum((full[i][k] - mean[i]) * (full[j][k] - mean[j]) for k in range(3)) / 2 for i in range(3) for j in range(i, 3)}
    got = {(r.i, r.j): r.cov for r in kernels.row_covariance(spark.createDataFrame(cells, "i long, j long, v double")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert kernels.row_covariance(spark.createDataFrame([], "i long, j long, v double")).count() == 0


def test_numbered_rows(spark):
    """Hot keys and ties: places are a permutation in the order of the keys."""
    rows = [(i % 3 if i % 2 else 1, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = numbered(df, F.desc("k"), "i").orderBy("place").collect()
    assert [(r.k, r.i) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1])) and [r.place for r in got] == list(range(5000))
    assert numbered(df.where("false"), "k").count() == 0
    assert dealt(df, 3, F.col("i")).groupBy(F.spark_partition_id().alias("p"), (F.col("i") % 3).alias("m")).count().where("p <> m").count() == 0


def test_long_word_lists(spark, tmp_path):
    """Lists beyond the literals give what comparing every word gives."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.choice([4, 6, 7]))) for _ in range(1500)})
    assert len(words) > 1000
    (tmp_path / "w").write_text(" ".join(words))
    lines = [f"{i}," + "".join(rng.choice("abcde") for _ in range(9)) for i in range(400)]
    for negative in (False, True):
        f = {"format_name": "x", "delims": ",", "fields": [{"name": "k", "pos": 0, "type": "string", "key": True}, {"name": "v", "pos": 1, "type": "string", "match": {"match_file": str(tmp_path / "w"), "logic": "or", "negative": negative}}]}
        got = {r._key for r in summarize(lines_from(spark, lines), load_format(f)).collect()}
        assert got == {x.split(",")[0] for x in lines if any(w in x.split(",")[1] for w in words) != negative} and got
