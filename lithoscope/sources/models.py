"""Exposure, fragility and taxonomy files (JSON), geometries (GeoJSON) and their checks; with ``lines`` each line is a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .responses import whole_filter

EXPOSURE = """metadata string, schema_version string, assets array<struct<id:string,name:string,aggregated:boolean,critical:boolean,
  reference_location:struct<longitude:double,latitude:double,elevation:double>,reference_geology:struct<vs30:double,soil_class:string>,
  typologies array<struct<taxonomy:string,count:double,usage:string,stories:int,replacement_cost:double,occupants:struct<day:double,night:double>>>>>""".replace("typologies array", "typologies:array")


def read_exposure(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """assets (asset_id, lon, lat, elevation, aggregated, vs30) and typologies (asset_id, taxonomy, n, ...)."""
    assets = spark.read.schema(EXPOSURE).json(path, multiLine=not lines).select(F.explode("assets").alias("a"))
    place = F.col("a.reference_location")
    head = assets.select(F.col("a.id").alias("asset_id"), place["longitude"].alias("lon"), place["latitude"].alias("lat"), F.coalesce(place["elevation"], F.lit(0.0)).alias("elevation"), F.col("a.aggregated").alias("aggregated"), F.col("a.reference_geology.vs30").alias("vs30"))
    kinds = assets.select(F.col("a.id").alias("asset_id"), F.explode("a.typologies").alias("t")).select("asset_id", "t.taxonomy", F.col("t.count").alias("n"), "t.usage", "t.stories", "t.replacement_cost", "t.occupants")
    return head, kinds


FRAGILITY = """models array<struct<id:string,taxonomy:string,imt:string,model_type:string,damage_scale:struct<id:string,levels:array<string>>,
  parameters:map<string,struct<theta:double,beta:double>>,tables:map<string,struct<im:array<double>,poe:array<double>,log_im:boolean>>>>"""


def read_fragility(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """model_id, imt, model_type, level_ord (from 1), level, theta, beta, points, log_im: a row for each level."""
    model = spark.read.schema(FRAGILITY).json(path, multiLine=not lines).select(F.explode("models").alias("m"))
    rows = model.select("m", F.posexplode("m.damage_scale.levels").alias("k", "level"))
    own, table = F.element_at("m.parameters", F.col("level")), F.element_at("m.tables", F.col("level"))
    points = F.arrays_zip(table["im"].alias("im"), table["poe"].alias("poe"))
    return rows.select(F.col("m.id").alias("model_id"), F.col("m.imt").alias("imt"), F.col("m.model_type").alias("model_type"), (F.col("k") + 1).alias("level_ord"), "level", own["theta"].alias("theta"), own["beta"].alias("beta"), points.alias("points"), table["log_im"].alias("log_im"))


def read_taxonomy(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """taxonomy, model_id, weight (1 unless given)."""
    tree = spark.read.schema("mappings map<string,struct<fragility_models:array<struct<id:string,weight:double>>>>").json(path, multiLine=not lines)
    rows = tree.select(F.explode("mappings").alias("taxonomy", "refs")).select("taxonomy", F.explode("refs.fragility_models").alias("r"))
    return rows.select("taxonomy", F.col("r.id").alias("model_id"), F.coalesce("r.weight", F.lit(1.0)).alias("weight"))


def _issue(df: DataFrame, path: Column, *rules: tuple[Column, str]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(path.alias("path"), F.lit(text).alias("message"))) for ok, text in rules)))
    return df.select(F.explode(found).alias("i")).select("i.*")


def exposure_issues(assets: DataFrame, typologies: DataFrame) -> DataFrame:
    """path, message of everything wrong, not only the first."""
    at = F.concat(F.lit("assets/"), F.coalesce(F.col("asset_id"), F.lit("?")))
    out = _issue(assets, at, (F.trim("asset_id") != "", "id is blank"), (F.col("lon").between(-180, 180), "longitude out of range"), (F.col("lat").between(-90, 90), "latitude out of range"))
    out = out.unionByName(_issue(typologies, at, (F.trim("taxonomy") != "", "taxonomy is blank"), (F.col("n") > 0, "count is not positive")))
    many = typologies.groupBy("asset_id").agg(F.count("*").alias("k")).join(assets.where(~F.col("aggregated")), "asset_id")
    twice = assets.groupBy("asset_id").agg(F.count("*").alias("k"))
    return out.unionByName(_issue(many, at, (F.col("k") == 1, "single asset with several typologies"))).unionByName(_issue(twice, at, (F.col("k") == 1, "id is not unique")))


def fragility_issues(levels: DataFrame) -> DataFrame:
    at = F.concat(F.lit("models/"), F.coalesce(F.col("model_id"), F.lit("?")), F.lit("/"), F.coalesce(F.col("level"), F.lit("?")))
    lognormal = F.col("model_type") == "lognormal"
    rising = F.forall(F.zip_with(F.slice("points", F.lit(1), F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", F.lit(2), F.greatest(F.size("points") - 1, F.lit(0))), lambda a, b: (a["im"] < b["im"]) & (a["poe"] <= b["poe"])), lambda x: x)
    return _issue(levels, at, (~lognormal | ((F.col("theta") > 0) & (F.col("beta") > 0)), "theta and beta must be positive"), (lognormal | ((F.size("points") >= 2) & rising), "table must rise"))


def taxonomy_issues(refs: DataFrame, levels: DataFrame) -> DataFrame:
    at = F.concat(F.lit("mappings/"), "taxonomy")
    known = levels.select("model_id").distinct().withColumn("known", F.lit(True))
    return _issue(refs.join(known, "model_id", "left"), at, (F.col("weight") > 0, "weight is not positive"), (F.col("known"), "model is unknown"))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """id, kind, parts (rings of lon, lat) of points, polygons and multipolygons, alone or in a collection."""
    schema = "type string, id string, geometry struct<type:string,coordinates:string>, features array<struct<id:string,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    alone = F.array(F.struct(F.col("id").alias("id"), F.col("geometry").alias("geometry")))
    rows = raw.select(F.explode(F.when(F.col("features").isNull(), alone).otherwise(F.col("features"))).alias("f")).select("f.id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    point = lambda x: F.struct(x[0].alias("lon"), x[1].alias("lat"))
    ring = lambda x: F.transform(x, point)
    one = F.array(F.array(point(F.from_json("c", "array<double>"))))
    many = F.array(ring(F.from_json("c", "array<array<double>>")))
    outer = F.transform(F.slice(F.from_json("c", "array<array<array<double>>>"), 1, 1), ring)
    multi = F.transform(F.from_json("c", "array<array<array<array<double>>>>"), lambda p: ring(p[0]))
    return rows.select("id", "kind", F.when(F.col("kind") == "Point", one).when(F.col("kind") == "MultiPoint", many).when(F.col("kind") == "Polygon", outer).otherwise(multi).alias("parts"))


STATIONXML = """_code string, Station array<struct<_code:string,Channel:array<struct<_code:string,_locationCode:string,_startDate:string,_endDate:string,
  Response:struct<Stage:array<struct<_number:int,StageGain:struct<Value:double,Frequency:double>,PolesZeros:struct<NormalizationFactor:double,
  Zero:array<struct<Real:double,Imaginary:double>>,Pole:array<struct<Real:double,Imaginary:double>>>,Coefficients:struct<Numerator:array<struct<_VALUE:double>>,
  Denominator:array<struct<_VALUE:double>>>,FIR:struct<Symmetry:string,NumeratorCoefficient:array<struct<_VALUE:double>>>,Polynomial:struct<Coefficient:array<struct<_VALUE:double>>>,
  Decimation:struct<InputSampleRate:double,Factor:int>>>>>>>>"""


def read_stationxml(spark: SparkSession, path: str) -> DataFrame:
    """sid, start, end, stage, gain, scale, poles, zeros, kind, numerators, denominators, rate, factor: a row for each stage of each epoch.

    What a stage has not is null; a stage with poles and zeros has both, empty where none is given.
    """
    nets = spark.read.format("xml").option("rowTag", "Network").schema(STATIONXML).load(path)
    channels = nets.select(F.col("_code").alias("net"), F.explode("Station").alias("s")).select("net", F.col("s._code").alias("sta"), F.explode("s.Channel").alias("c"))
    sid = F.concat_ws(".", "net", "sta", F.coalesce("c._locationCode", F.lit("")), "c._code")
    date = lambda c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
    stages = channels.select(sid.alias("sid"), date("c._startDate").alias("start"), date("c._endDate").alias("end"), F.explode("c.Response.Stage").alias("g"))
    g = F.col("g")
    kind = F.when(g["PolesZeros"].isNotNull(), "paz").when(g["FIR"].isNotNull(), "fir").when(g["Polynomial"].isNotNull(), "polynomial").when(g["Coefficients"].isNotNull(), "coefficients")
    values = lambda c: F.coalesce(F.transform(c, lambda x: x["_VALUE"]), F.array().cast("array<double>"))
    roots = lambda name: F.when(kind == "paz", F.coalesce(g["PolesZeros"][name], F.array().cast("array<struct<Real:double,Imaginary:double>>")))
    fir = whole_filter(F.lower(F.coalesce(g["FIR"]["Symmetry"], F.lit("none"))), values(g["FIR"]["NumeratorCoefficient"]))
    numerators = F.when(kind == "fir", fir).when(kind == "polynomial", values(g["Polynomial"]["Coefficient"])).when(kind == "coefficients", values(g["Coefficients"]["Numerator"]))
    return stages.select(
        "sid", "start", "end", g["_number"].alias("stage"), g["StageGain"]["Value"].alias("gain"), g["PolesZeros"]["NormalizationFactor"].alias("scale"), roots("Pole").alias("poles"), roots("Zero").alias("zeros"),
        kind.alias("kind"), numerators.alias("numerators"), F.when(kind == "coefficients", values(g["Coefficients"]["Denominator"])).alias("denominators"), g["Decimation"]["InputSampleRate"].alias("rate"), g["Decimation"]["Factor"].alias("factor"),
    )
