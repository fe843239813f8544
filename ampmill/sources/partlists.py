"""Part list sources (A1-A16, A19, A24) as scans into one schema, with ord for the arrival order.

Spreadsheets are read as exported CSV; nothing is fetched. Every reader is a scan with projections, so a
snapshot of any size is read in parallel and only the columns used are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampmill.operators.observations import field_value
from ampmill.operators.text import maker_tag

FIELDS = {"mfr": "string", "mpn": "string", "mpn2": "string", "ds_url": "string", "package": "string", "status": "string", "source": "string", "substrate": "string", "vds_max": "double", "rds_on_10v_max": "double", "id_25": "double", "vgs_th_min": "double", "vgs_th_max": "double", "qg_typ_nc": "double", "qg_max_nc": "double", "ord": "bigint"}


def discovered(df: DataFrame, **columns: Column | str | None) -> DataFrame:
    """Projection to the common schema; columns not given are null."""
    get = lambda c: c if isinstance(c, Column) else F.lit(c)
    return df.select(*[get(columns.get(name)).cast(kind).alias(name) for name, kind in FIELDS.items() if name != "ord"], F.monotonically_increasing_id().alias("ord"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _head(c: Column, sep: str = "@") -> Column:
    return F.trim(F.split(c, sep)[0])


def _scaled(c: Column) -> Column:
    """"4.5mOhm" or "60 nC" in Ω or nC."""
    n = F.regexp_extract(c, r"([\d.]+)\s*([a-zA-ZµμΩ]*)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(c, r"([\d.]+)\s*([a-zA-ZµμΩ]*)", 2))
    return n * F.when(unit.isin("mohm", "mω"), 1e-3).when(unit.isin("uc", "µc", "μc"), 1e3).otherwise(1.0)


def distributor_csv(spark: SparkSession, glob: str, no_obsolete: bool = False) -> DataFrame:
    """The distributor's export (A1). Discontinued parts are always left out, obsolete ones on request."""
    d = _csv(spark, glob)
    status = _c("Product Status")
    d = d.filter(~(F.coalesce(status.startswith("Discontinued"), F.lit(False)) | (F.coalesce(status == "Obsolete", F.lit(False)) if no_obsolete else F.lit(False))))
    current = F.regexp_extract(F.element_at(F.split(F.regexp_replace(_c("Current - Continuous Drain (Id) @ 25°C"), r"[ ,]+$", ""), ","), -1), r"([\d.]+)", 1)
    return discovered(
        d, mfr=maker_tag(_c("Mfr")), mpn=_c("Mfr Part #"), ds_url=_c("Datasheet"), package=_c("Package / Case"), status=status, source="distributor", substrate=F.when(_c("Technology").startswith("GaN"), "GaN"),
        vds_max=F.regexp_extract(_c("Drain to Source Voltage (Vdss)"), r"([\d.]+)", 1).try_cast("double"), rds_on_10v_max=_scaled(_head(_c("Rds On (Max) @ Id, Vgs"))), qg_max_nc=_scaled(_head(_c("Gate Charge (Qg) (Max) @ Vgs"))), id_25=current.try_cast("double"),
        vgs_th_max=field_value(F.regexp_replace(_head(_c("Vgs(th) (Max) @ Id")), "V", "")),
    )


@dataclass
class VendorSheet:
    """How a vendor's exported sheet maps to the common schema: column names (fixed values) and quirks."""

    mfr: str
    columns: dict[str, str]
    factors: dict[str, float] = field(default_factory=dict)
    where: str | None = None
    substrate: Column | str | None = None
    fixes: dict[str, dict[str, float]] = field(default_factory=dict)
    first_of_list: bool = False
    url: str | None = None


# The vendors' column names.
VENDOR_SHEETS = {
    "infineon": VendorSheet("infineon", {"mpn": "Part number", "mpn2": "OPN", "ds_url": "Datasheet link", "package": "Package name", "vds_max": "VDS max", "rds_on_10v_max": "RDS (on) (@10V) max", "id_25": "ID  (@25°C) max", "vgs_th_min": "VGS(th) min", "vgs_th_max": "VGS(th) max", "qg_typ_nc": "QG (typ @10V)", "qg_max_nc": "QG (typ @10V) max"}, first_of_list=True),
    "onsemi": VendorSheet("onsemi", {"mpn": "Product Group", "package": "Package Type", "vds_max": "V(BR)DSS Min (V)", "rds_on_10v_max": "RDS(on) Max @ VGS = 10 V  (mΩ)", "id_25": "ID Max (A)", "vgs_th_max": "Vgs(th) Max (V)", "qg_typ_nc": "Qg Typ @ VGS = 10 V (nC)"}, {"rds_on_10v_max": 1e-3}, "`Channel Polarity` <> 'Complementary' AND Configuration = 'Single'"),
    "ti": VendorSheet("ti", {"mpn": "Product or Part number", "ds_url": "PDF datasheet", "package": "Package type", "vds_max": "VDS (V)", "rds_on_10v_max": "Rds(on) at VGS=10 V (max) (mΩ)", "id_25": "ID - continuous drain current at TA=25°C (A)"}, {"rds_on_10v_max": 1e-3}),
    "toshiba": VendorSheet("toshiba", {"mpn": "Part Number", "ds_url": "Datasheet", "package": "Toshiba Package Name", "vds_max": "VDSS(V)", "rds_on_10v_max": "RDS(ON)Max(Ω)|VGS|=10V", "id_25": "ID(A)", "qg_typ_nc": "Qg(nC)"}),
    "ts": VendorSheet("ts", {"mpn": "Part Number", "ds_url": "Datasheet", "package": "Package", "vds_max": "VDS (V)", "rds_on_10v_max": "RDS(ON) @ 10V Max. (mΩ)", "id_25": "ID Max. (A)", "vgs_th_min": "VGS(th) Min. (V)", "vgs_th_max": "VGS(th) Max. (V)", "qg_typ_nc": "Qg (nC) @ 10V"}, {"rds_on_10v_max": 1e-3}),
    "ao": VendorSheet("ao", {"mpn": "Product", "package": "Package", "vds_max": "VDS (V)", "rds_on_10v_max": "RDS(ON) max (mΩ) at VGS=10V", "id_25": "ID @ 25°C (A)", "vgs_th_max": "VGS(th) max (V)", "qg_typ_nc": "Qg (10V)(nC)"}, {"rds_on_10v_max": 1e-3}, fixes={"AOK60N30L": {"rds_on_10v_max": 0.1}}),
    "epc": VendorSheet("epc", {"mpn": "PartNumber", "package": "Package(mm)", "vds_max": "VDSmax", "rds_on_10v_max": "MaxRDS(on)(mΩ)@5VGS", "id_25": "ID (A)", "qg_typ_nc": "QGtyp(nC)"}, {"rds_on_10v_max": 1e-3}, "Configuration LIKE 'Single%'", "GaN", first_of_list=True),
    "nxp": VendorSheet("nxp", {"mpn": "Type number", "ds_url": "Datasheet", "package": "Package name", "vds_max": "VDS [max] (V)", "rds_on_10v_max": "RDSon [max] @ VGS = 10 V (mΩ)", "id_25": "ID [max] (A)", "qg_typ_nc": "QG(tot) [typ] @ VGS = 10 V (nC)"}, {"rds_on_10v_max": 1e-3}),
}
TEXTS = ("mpn", "mpn2", "ds_url", "package")


def vendor_csv(spark: SparkSession, vendor: str, path: str) -> DataFrame:
    """A vendor's sheet (A2-A4, A6-A10): line-end marks and list tails cut, hyperlink formulas resolved, plausibility limits applied."""
    v = VENDOR_SHEETS[vendor]
    d = _csv(spark, path)
    if v.where:
        d = d.filter(v.where)
    cols = {}
    for name, source in v.columns.items():
        if source not in d.columns:
            continue
        c = F.split(_c(source), "_x000d_")[0]
        if name in TEXTS:
            link = F.regexp_extract(c, r'^=HYPERLINK\("([^"]+)", ?"([^"]+)"\)', 1 if name == "ds_url" else 2)
            cols[name] = F.when(c.startswith("=HYPERLINK"), link).otherwise(F.nullif(c, F.lit("nan")))
        else:
            c = F.split(c, ",")[0] if v.first_of_list else c
            cols[name] = field_value(F.trim(F.regexp_replace(c, r"^[± ]+|\s*(?:V|A|nC|mΩ)\s*$", ""))) * v.factors.get(name, 1.0)
    for mpn, factors in v.fixes.items():
        for name, factor in factors.items():
            cols[name] = cols[name] * F.when(cols["mpn"] == mpn, factor).otherwise(1.0)
    if vendor == "onsemi":
        cols["rds_on_10v_max"] = F.when(cols["rds_on_10v_max"] > 0.1e-3, cols["rds_on_10v_max"])
        cols["vgs_th_max"] = F.when(cols["vgs_th_max"] < 10, cols["vgs_th_max"])
    substrate = F.when(cols["mpn"].startswith("GAN"), "GaN").otherwise("Si") if vendor == "nxp" else F.when(_c("Technology").contains("CoolSiC"), "SiC").otherwise("Si") if vendor == "infineon" else v.substrate
    return discovered(d, mfr=v.mfr, source=f"{vendor}_products", substrate=substrate, **cols)


def grid_json(spark: SparkSession, path: str, mfr: str = "st") -> DataFrame:
    """A column/row grid (A5): cells joined to their columns' names, tags stripped, pivoted to records."""
    s = "columns array<struct<id:string,name:string>>, rows array<struct<cells:array<struct<columnId:string,value:string>>>>"
    d = spark.read.schema(s).json(path, multiLine=True).withColumn("file", F.input_file_name())
    names = d.select("file", F.explode("columns").alias("c")).select("file", F.col("c.id").alias("column"), F.regexp_replace("c.name", "<!--.*?-->|<[^>]*>", "").alias("name"))
    cells = d.select("file", F.posexplode("rows").alias("row", "r")).select("file", "row", F.explode("r.cells").alias("c")).select("file", "row", F.col("c.columnId").alias("column"), "c.value")
    wanted = ["Part Number", "Package", "VDSS", "RDS(on)", "Drain Current (Dc)", "Qg"]
    r = cells.join(names, ["file", "column"]).groupBy("file", "row").pivot("name", wanted).agg(F.first("value"))
    num = lambda c: field_value(_c(c))
    return discovered(r, mfr=mfr, mpn=_c("Part Number"), package=_c("Package"), vds_max=num("VDSS"), rds_on_10v_max=num("RDS(on)"), id_25=num("Drain Current (Dc)"), qg_typ_nc=num("Qg"), source="st.com")


def embedded_json_html(spark: SparkSession, path: str) -> DataFrame:
    """A page whose table is JSON inside a script element, with coded columns (A11); dual parts are left out."""
    codes = "array<struct<P1000:string,P1001:string,P7000:string,P7002:string,P7006:string,P7013:string,P7023:string>>"
    page = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r'(?s)<script id="__NEXT_DATA__" type="application/json">(.+?)</script>', 1).alias("j"))
    r = page.select(F.explode(F.from_json("j", f"struct<props:struct<pageProps:struct<webtableResults:{codes}>>>")["props"]["pageProps"]["webtableResults"]).alias("r")).select("r.*").filter("P7000 is null or P7000 <> 'Dual'")
    num = lambda c: F.nullif(field_value(F.col(c)), F.lit(0.0))
    return discovered(r, mfr="vishay", mpn=F.col("P1001"), ds_url=F.concat(F.lit("https://www.vishay.com/doc?"), F.col("P1000")), vds_max=num("P7002"), rds_on_10v_max=num("P7013"), qg_typ_nc=num("P7023"), id_25=num("P7006"), source="vishay.com")


def brand_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a brand interface (A13): parameter lists become records; p-channel voltages negative; milliohms given as ohms put right."""
    item = "struct<brandNameEn:string,productModel:string,productNameEn:string,pdfUrl:string,encapStandard:string,paramVOList:array<struct<paramNameEn:string,paramValueEnForSearch:double>>>"
    d = spark.read.schema(f"result struct<dataList:array<{item}>>").json(path, multiLine=True)
    r = d.select(F.explode("result.dataList").alias("r")).select("r.*")
    params = F.map_from_entries(F.filter(F.transform(F.coalesce("paramVOList", F.array().cast("array<struct<paramNameEn:string,paramValueEnForSearch:double>>")), lambda p: F.struct(p["paramNameEn"].alias("k"), p["paramValueEnForSearch"].alias("v"))), lambda e: e["k"].isNotNull()))
    get = lambda k: F.nullif(F.try_element_at(F.col("p"), F.lit(k)), F.lit(0.0))
    r = r.withColumn("p", params).withColumns({"v": get("Drain to Source Voltage"), "r": get("RDS(on)"), "i": get("Current - Continuous Drain(Id)")})
    rds = F.when((F.col("v") >= 1000) & (F.col("r") < 0.6) & (F.col("i") < 2), F.col("r") * 1000).otherwise(F.col("r"))
    plausible = F.coalesce(F.try_divide(rds * 1000, F.abs("v")).between(0.002, 1000), F.lit(True))
    v = F.when((F.col("v") > 0) & F.lower(F.coalesce("productNameEn", F.lit(""))).contains("p-channel"), -F.col("v")).otherwise(F.col("v"))
    return discovered(r, mfr=maker_tag(F.col("brandNameEn")), mpn=F.col("productModel"), ds_url=F.col("pdfUrl"), package=F.col("encapStandard"), vds_max=v, rds_on_10v_max=F.when(plausible, rds), id_25=F.col("i"), source="lcsc")


def html_cells(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Records from page markup (A12, A14): each field is the n-th text of the elements of a class, lists zipped to rows."""
    page = spark.read.text(path, wholetext=True)
    lists = [F.regexp_extract_all("value", F.lit(rf'(?s)class="[^"]*\b{css}\b[^"]*"[^>]*>\s*(?:<[^>]+>\s*)*([^<]*)'), 1).alias(name) for name, css in fields.items()]
    return page.select(*lists).select(F.explode(F.arrays_zip(*fields)).alias("r")).select(*[F.trim(F.col("r")[n]).alias(n) for n in fields])


def all_sources(*frames: DataFrame) -> DataFrame:
    """Union in the order given: ord keeps each source's rows behind those of the one before."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("ord", F.col("ord") + F.lit(k) * F.lit(1 << 55))
        out = f if out is None else out.unionByName(f)
    return out


def snapshot_path(root: str, source: str, month: str) -> str:
    """Month-stamped snapshots are a partition column: readers prune to one month."""
    return f"{root}/{source}/snapshot={month}"


def run_config(path: str) -> dict:
    """A run's YAML settings with numbers such as 80e3 as floats."""
    import yaml

    def numeric(x):
        if isinstance(x, dict):
            return {k: numeric(v) for k, v in x.items()}
        if isinstance(x, list):
            return [numeric(v) for v in x]
        try:
            return float(x) if isinstance(x, str) else x
        except ValueError:
            return x

    return numeric(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


#: Rows that go into one file; longer reports are written as parts in sorted order.
REPORT_ROWS = 1_000_000


def write_ranked_csv(df: DataFrame, path: str, sort: list[str], digits: int | dict[str, int] = 3) -> None:
    """A sorted CSV report (B1): numbers to significant digits (of all columns, or by column), missing last.

    One file up to REPORT_ROWS rows; a longer report stays in its range-partitioned parts, in order.
    """
    from ampmill.operators.loss import round_sig

    n = lambda c: digits.get(c, 3) if isinstance(digits, dict) else digits
    out = df.select(*[round_sig(F.col(f.name), n(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])
    by = [F.col(c).asc_nulls_last() for c in sort if c in df.columns]
    short = out.count() <= REPORT_ROWS
    (out.coalesce(1).sortWithinPartitions(*by) if short and by else out.coalesce(1) if short else out.orderBy(*by)).write.mode("overwrite").option("header", True).csv(path)
