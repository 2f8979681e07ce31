import hashlib
import random
import zlib

from loomframe.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes):
    """Levels of a tree; and for each leaf the places on the way."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, at, node):
    beside = []
    for level in levels[:-1]:
        low = at // 16 * 16
        left, right = level[low:at], level[at + 1 : low + 16]
        beside += left + right
        node = H(*left, node, *right)
        at //= 16
    return beside, node


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda s: b"" if s is None else b"s" + s.encode())
    for s in trees:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    grown = {s: grow([leaf(r) for r in trees[s]]) for s in names}
    top = grow([grown[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, row in enumerate(trees[s]):
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            changed = leaf((*row[:4], text))
            one, sub = climb(grown[s], at, changed)
            two, end = climb(top, k, sub)
            out.append((row[0], leaf(row), grown[s][-1][0], top[-1][0], H(*one, *two), end, end == top[-1][0]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    for sizes in ({"a": 300, "b": 17, "é": 16, None: 5, "": 1, "z": 257}, {"only": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}):
        rows, i = [], 0
        for source, n in sizes.items():
            for _ in range(n):
                i += 1
                text = rng.choice([None, "", "Some TEXT", "ÀÉ Text É", "no capitals", "x" * 5000 + "Y"])
                rows.append((rng.choice([i, i, None if rng.random() < 0.1 else i]), source, rng.choice(["en", None]), rng.choice([3, None, -1]), text))
        rows += rows[:3] * 2
        rng.shuffle(rows)
        got = manifest.audited(spark.createDataFrame(rows, SCHEMA))
        columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
        assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == brute(rows)


def test_a_proof_leads_to_the_root_and_only_its_own_row_does(spark):
    rows = [(i, "s" if i % 3 else "t", "en", 1, f"Text {i}") for i in range(100)]
    found = manifest.proofs(spark.createDataFrame(rows, SCHEMA)).withColumn("end", manifest.folded(manifest.F.col("leaf"), manifest.F.col("path")))
    assert found.where("end = root").count() == 100 and found.select("root").distinct().count() == 1
    assert found.withColumn("end", manifest.folded(manifest.F.sha2("leaf", 256), manifest.F.col("path"))).where("end = root").count() == 0


def test_a_hot_source_is_many_partitions_and_an_empty_table_has_no_root(spark):
    rows = spark.range(20_000).selectExpr("cast(null as bigint) doc_id", "'hot' source", "'en' lang", "1L n_chars", "'the same text' text")
    trees = manifest.grow(rows.select(manifest.F.lit("shot").alias("tree"), manifest.F.col("doc_id").alias("id"), manifest.leaf([manifest.F.col(c) for c in manifest.FIELDS]).alias("digest")), ["id", "digest"])
    placed = trees.leaves.agg(manifest.F.countDistinct("pos"), manifest.F.min("pos"), manifest.F.max("pos")).first()
    assert tuple(placed) == (20_000, 0, 19_999) and [x.count() for x in trees.levels] == [1250, 79, 5, 1]
    ranged = rows.withColumn("_met", manifest.F.monotonically_increasing_id()).repartitionByRange(4, "doc_id", "_met").groupBy(manifest.F.spark_partition_id()).count()
    assert ranged.agg(manifest.F.max("count")).first()[0] < 10_000
    extra = spark.createDataFrame([], SCHEMA + ", pos int, tree string, path string, digest string")
    assert manifest.audited(extra).collect() == []


def test_clashing_columns_are_not_read(spark):
    rows = [(1, "s", "en", 1, "A", 5, "x", "y"), (2, None, None, None, None, 6, "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA + ", pos int, tree string, digest string")
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf")) for r in manifest.audited(frame).collect())) == sorted((r[0], leaf(r[:5])) for r in rows)
