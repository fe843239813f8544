"""Part list readers and the stream, on files written by the tests."""

import datetime as dt
import json

from ampmill.sources import partlists as pl
from ampmill.streaming import observations as st

HEAD = 'Mfr,Mfr Part #,Datasheet,Product Status,Technology,Drain to Source Voltage (Vdss),"Rds On (Max) @ Id, Vgs",Gate Charge (Qg) (Max) @ Vgs,Current - Continuous Drain (Id) @ 25°C,Vgs(th) (Max) @ Id,Package / Case\n'


def test_distributor_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + 'Texas Instruments,A1,u,Active,GaNFET,100 V,"5mOhm @ 20A, 10V",60 nC @ 10 V,"10A (Ta), 18A (Tc)",2.5V @ 1mA,TO-220\nX,B,u,Obsolete,MOSFET,,,,,,\nX,C,u,Discontinued at X,MOSFET,,,,,,\n', encoding="utf-8")
    rows = {r.mpn: r for r in pl.distributor_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert set(rows) == {"A1", "B"} and pl.distributor_csv(spark, str(tmp_path / "*.csv"), True).count() == 1
    a = rows["A1"]
    assert (a.mfr, a.substrate, a.vds_max, a.rds_on_10v_max, a.qg_max_nc, a.id_25, a.vgs_th_max) == ("ti", "GaN", 100.0, 0.005, 60.0, 18.0, 2.5)
    assert rows["B"].vds_max is None


def test_vendor_sheets(spark, tmp_path):
    f = tmp_path / "o.csv"
    f.write_text('Product Group,Package Type,V(BR)DSS Min (V),RDS(on) Max @ VGS = 10 V  (mΩ),ID Max (A),Vgs(th) Max (V),Qg Typ @ VGS = 10 V (nC),Channel Polarity,Configuration\nN1,DPAK,±60,4.5,50,±20,30,N-Channel,Single\nN2,x,60,1,1,1,1,Complementary,Single\nN3,x,60,0.05,1,2,1,N-Channel,Single\n', encoding="utf-8")
    rows = {r.mpn: r for r in pl.vendor_csv(spark, "onsemi", str(f)).collect()}
    assert set(rows) == {"N1", "N3"} and abs(rows["N1"].rds_on_10v_max - 4.5e-3) < 1e-12 and rows["N1"].vgs_th_max is None and rows["N1"].vds_max == 60 and rows["N3"].rds_on_10v_max is None
    g = tmp_path / "t.csv"
    g.write_text('Product or Part number,PDF datasheet,VDS (V)\n"=HYPERLINK(""https://x/y"", ""CSD1"")","=HYPERLINK(""https://x/d.pdf"", ""PDF"")",40\n', encoding="utf-8")
    r = pl.vendor_csv(spark, "ti", str(g)).collect()[0]
    assert (r.mpn, r.ds_url, r.vds_max, r.package) == ("CSD1", "https://x/d.pdf", 40.0, None)


def test_grid_and_brand_json(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"columns": [{"id": "1", "name": "Part <b>Number</b>"}, {"id": "2", "name": "VDSS"}], "rows": [{"cells": [{"columnId": "1", "value": "STB1"}, {"columnId": "2", "value": "100"}]}]}))
    r = pl.grid_json(spark, str(tmp_path / "g.json")).collect()[0]
    assert (r.mpn, r.vds_max, r.qg_typ_nc) == ("STB1", 100.0, None)
    p = lambda **k: [{"paramNameEn": a.replace("_", " "), "paramValueEnForSearch": b} for a, b in k.items()]
    items = [{"brandNameEn": "Infineon", "productModel": "P1", "productNameEn": "P-Channel", "paramVOList": p(Drain_to_Source_Voltage=60.0)}, {"brandNameEn": "x y", "productModel": "P2", "paramVOList": None}]
    (tmp_path / "b.json").write_text(json.dumps({"result": {"dataList": items}}))
    got = {r.mpn: (r.mfr, r.vds_max) for r in pl.brand_json(spark, str(tmp_path / "b.json")).collect()}
    assert got == {"P1": ("infineon", -60.0), "P2": ("x_y", None)}


def test_embedded_json_and_union(spark, tmp_path):
    page = {"props": {"pageProps": {"webtableResults": [{"P1000": "7", "P1001": "SI1", "P7000": "Single", "P7002": "80", "P7013": "0.004"}, {"P1001": "SI2", "P7000": "Dual"}]}}}
    (tmp_path / "v.html").write_text(f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(page)}</script></html>')
    v = pl.embedded_json_html(spark, str(tmp_path / "v.html"))
    u = pl.all_sources(v, v).collect()
    assert [r.mpn for r in sorted(u, key=lambda r: r.ord)] == ["SI1", "SI1"] and len({r.ord for r in u}) == 2 and u[0].rds_on_10v_max == 0.004


def test_stream_folds_micro_batches(spark, tmp_path):
    rows = [(1, 1, "Vsd", None, 7.0, None, dt.datetime(2024, 1, 1)), (1, 2, "Vsd", None, None, 9.0, dt.datetime(2024, 1, 1))]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for r in rows:
        spark.createDataFrame([r], st.SCHEMA).coalesce(1).write.mode("append").parquet(src)
    q = st.fuse_into(st.read(spark, src), out, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    last = spark.read.parquet(f"{out}/fused").orderBy("epoch", ascending=False).first()
    assert (last.vtyp, last.vmax) == (7.0, 9.0)
