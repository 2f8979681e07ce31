import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomframe.functions import color, dims, hashing, rules, text


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_delta_e_published_pairs(spark):
    rows = [
        (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
        (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
        (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
        (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
        (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373),
    ]
    df = spark.createDataFrame(rows, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    lab = lambda k: F.struct(F.col(f"l{k}").alias("l"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"))
    for r in color.with_delta_e(df.withColumns({"p": lab(1), "q": lab(2)}), "p", "q", "de").collect():
        assert r["de"] == pytest.approx(r["want"], abs=1e-4)


def test_color_names_and_hex(spark):
    df = spark.createDataFrame([(1, 25, 35, 72), (2, 250, 250, 250), (3, 205, 30, 45)], "k int, r int, g int, b int")
    named = color.nearest_color(df.select("k", color.srgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")), "k", "lab")
    assert {r["k"]: r["color"] for r in named.collect()} == {1: "네이비", 2: "화이트", 3: "레드"}
    assert one(spark, color.to_hex(F.lit(0.5), F.lit(254.6), F.lit(16.0)))[0] == "#00FF10"


BODY = "height double, shoulder_width double, chest double, waist double, hip double, thigh double, arm_length double, inseam double, landmarks map<string,double>"


def report(spark, garment, body, kind="top", stretch="없음"):
    names = ("shoulder", "chest", "length", "sleeve", "waist", "hip", "thigh", "inseam", "rise")
    g = spark.createDataFrame([tuple(float(garment[n]) if n in garment else None for n in names)], ", ".join(f"{n} double" for n in names)).select(F.struct("*").alias("g"))
    fields = BODY.replace(", ", ",").split(",")
    b = spark.createDataFrame([tuple(body.get(f.split()[0]) for f in ("height double", "shoulder_width double", "chest double", "waist double", "hip double", "thigh double", "arm_length double", "inseam double")) + (body.get("landmarks", {}),)], BODY).select(F.struct("*").alias("b"))
    assert len(fields) >= 9
    make = rules.top_report if kind == "top" else rules.bottom_report
    args = ("상의",) if kind == "top" else ()
    row = g.join(b).select(make(F.col("g"), F.col("b"), *args, F.lit(stretch)).alias("r")).select("r", rules.summary(F.col("r")).alias("s")).first()
    return {z["zone"]: z["label"] for z in row["r"]["zones"]}, row["r"]["warnings"], row["r"]["estimated"], row["s"]


def test_top_reports(spark):
    zones, warnings, estimated, summary = report(spark, {"shoulder": 52, "chest": 58, "length": 72, "sleeve": 22}, {"height": 175.0, "shoulder_width": 44.0, "chest": 96.0, "arm_length": 57.0})
    assert zones == {"어깨": "드롭숄더", "가슴": "세미오버", "기장": "엉덩이를 덮음", "소매": "팔꿈치 위"}
    assert warnings == [] and estimated == [] and summary.startswith("어깨 드롭숄더, ")
    zones, warnings, estimated, _ = report(spark, {"shoulder": 42, "chest": 50, "sleeve": 60}, {"height": 175.0, "shoulder_width": 46.0, "chest": 104.0})
    assert zones["어깨"] == "작음" and len(warnings) == 1 and estimated == ["arm_length"]
    labels = [report(spark, {"chest": 49}, {"height": 170.0, "chest": 90.0}, stretch=s)[0]["가슴"] for s in ("없음", "많음")]
    assert labels == ["슬림", "레귤러"]


def test_bottom_report(spark):
    zones, *_ = report(spark, {"waist": 41, "hip": 52, "thigh": 32, "inseam": 76}, {"height": 175.0, "waist": 80.0, "hip": 96.0, "thigh": 56.0, "inseam": 78.0}, "bottom")
    assert zones == {"허리": "딱 맞음", "엉덩이": "레귤러", "허벅지": "레귤러", "기장": "기본(신발에 살짝 닿음)"}


def test_care_and_reasons(spark):
    care = lambda m, s: tuple(one(spark, rules.default_care(F.lit(m).cast("string"), F.lit(s).cast("string")))[0])
    assert care("소가죽", None) == ("드라이클리닝", 0) and care(None, "니트") == ("울코스", 30) and care(None, None) == ("일반세탁", 40)
    interval = rules.interval(F.lit(0.0), F.lit("상의"), F.lit("니트"))
    assert one(spark, interval, rules.interval(F.lit(None).cast("double"), F.lit("?"), F.lit("?")))[:] == (4.0, 3.0)
    got = one(spark, rules.first_reason([("a", F.lit(None).cast("boolean")), ("b", F.lit(True))]), rules.all_reasons([("a", F.lit(True)), ("b", F.lit(False)), ("c", F.lit(True))]))
    assert got[0] == "b" and got[1] == ["a", "c"]


def test_outfit_color_scores(spark):
    from loomframe.operators.outfits import hue_map

    def score(*colors):
        c = F.array(*(F.lit(x) for x in colors))
        return one(spark, rules.color_score(rules.accents(c), F.array(*(F.lit("무지") for _ in colors)), hue_map()))[0]

    assert [score("화이트", "블랙"), score("레드", "블랙"), score("레드", "옐로우", "퍼플")] == [0.85, 1.0, 0.3]
    assert score("레드", "버건디") == 0.8 and score("레드", "그린") == 0.55


def test_text(spark):
    ok = [one(spark, text.license_ok(F.lit(n)))[0] for n in ("CC BY-SA 4.0", "CC BY-NC 4.0", "Public domain", "", "CC BY-ND 2.0", "GPL")]
    assert ok == [True, False, True, False, False, False]
    row = one(spark, text.clean(F.lit("<p>a &amp; b</p> ")), text.year_of(F.lit("c. 1887, shown 2001")).cast("string"), text.rights_name(F.lit("http://x/licenses/by-sa/4.0/")), text.license_name(F.lit("cc0"), F.lit("1.0")), text.fenced_json(F.lit('```json\n{"a": 1}\n```')), text.fenced_json(F.lit("nope{")))
    assert row[:] == ("a & b", "2001", "CC BY-SA 4.0", "CC0", '{"a": 1}', None)
    assert one(spark, text.text_ratio(F.lit("A-b c"), F.lit("abc")), text.text_ratio(F.lit("!"), F.lit("?")))[:] == (1.0, 1.0)


def test_hash_buckets(spark):
    import hashlib

    names = [f"f{i}.jpg" for i in range(2000)]
    df = spark.createDataFrame([Row(n=n) for n in names]).select("n", hashing.bucket(F.col("n")).alias("b"), hashing.split_of(F.col("n"), dims.LAYERED_SPLITS, {"f7.jpg": "exp0"}).alias("s"))
    rows = df.collect()
    assert all(r["b"] == int(hashlib.sha1(r["n"].encode()).hexdigest()[:8], 16) % 100 for r in rows)
    assert 0.15 < sum(r["s"] == "report" for r in rows) / 2000 < 0.25 and [r["s"] for r in rows if r["n"] == "f7.jpg"] == ["exp0"]
