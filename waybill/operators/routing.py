"""Visit orders, manual swaps, address candidates and navigation links."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.semantics import code_unit_sum, squeeze
from waybill.functions.text import ADDRESS_DETAIL

# Start of the day, names of regions, words that are no address (fixed values).
START = (37.5033, 127.0442)
REGIONS = "서울|경기|인천|부산|대구|대전|광주|울산|세종|제주|강원|충청|충북|충남|전라|전북|전남|경상|경북|경남"
ADDRESS_NOISE = r"(?i)(?:tel|hp|전화|연락처|휴대폰|핸드폰|받는\s*분|수령|인수|발주|배송화원|상품|메모|비고)"


#: Stops that are searched all at once; with more left, cells around the last stop are searched first.
DENSE = 512


def _squares(lat: np.ndarray, lon: np.ndarray, at: tuple[float, float]) -> np.ndarray:
    """What the distance from ``at`` grows with (radians): the square of half the chord."""
    return np.sin((lat - at[0]) / 2) ** 2 + np.cos(at[0]) * np.cos(lat) * np.sin((lon - at[1]) / 2) ** 2


def greedy_tour(lat: np.ndarray, lon: np.ndarray, start: tuple[float, float], dense: int = DENSE) -> list[int]:
    """Places in visiting order (radians): the nearest one left, the earliest among equals; places that are no numbers last.

    Places lie in a grid of cells. Rings of cells around the last stop are searched until what they hold is nearer than
    anything beyond them can be, so a stop costs a few cells and not all that are left.
    """
    known = np.flatnonzero(~(np.isnan(lat) | np.isnan(lon)))
    out, at, n = [], start, len(known)
    side = max(1, int(np.sqrt(n / 2)))
    low = (lat[known].min(), lon[known].min()) if n else (0.0, 0.0)
    size = tuple(max(1e-9, float(np.ptp(x[known])) / side * 1.000001) for x in (lat, lon)) if n else (1.0, 1.0)
    cells: dict[tuple[int, int], list[int]] = {}
    where = [((lat[known] - low[0]) // size[0]).astype(int), ((lon[known] - low[1]) // size[1]).astype(int)]
    for i, x, y in zip(known.tolist(), *(w.tolist() for w in where), strict=True):
        cells.setdefault((x, y), []).append(i)
    # widest at the latitude where a degree of longitude is shortest
    narrow = float(np.cos(np.abs(np.append(lat[known], start[0])).max())) if n else 1.0
    while n - len(out) > dense:
        x, y = int((at[0] - low[0]) // size[0]), int((at[1] - low[1]) // size[1])
        best, ring = (np.inf, -1), 0
        reach = max(abs(x), abs(y), abs(x - side), abs(y - side)) + 1
        while ring <= reach:
            edge = [(x + i, y + j) for i in range(-ring, ring + 1) for j in ((-ring, ring) if abs(i) < ring else range(-ring, ring + 1))] if ring else [(x, y)]
            near = [i for c in edge if c in cells for i in cells[c]]
            if near:
                a = _squares(lat[near], lon[near], at)
                best = min(best, min(zip(a.tolist(), near, strict=True)))
            if best[0] < min(np.sin(min(np.pi, ring * size[0]) / 2) ** 2, (narrow * np.sin(min(np.pi, ring * size[1]) / 2)) ** 2):
                break
            ring += 1
        i = best[1]
        out.append(i)
        at = (lat[i], lon[i])
        cell = (int((at[0] - low[0]) // size[0]), int((at[1] - low[1]) // size[1]))
        cells[cell].remove(i)
        if not cells[cell]:
            del cells[cell]
    left = np.array(sorted(i for c in cells.values() for i in c), int)
    while len(left):
        j = int(np.argmin(_squares(lat[left], lon[left], at)))
        out.append(int(left[j]))
        at = (lat[left[j]], lon[left[j]])
        left = np.delete(left, j)
    return out + [i for i in range(len(lat)) if np.isnan(lat[i]) or np.isnan(lon[i])]


def nearest_neighbor(stops: DataFrame, route: str = "route", ord: str = "ord", start: tuple[float, float] = START) -> DataFrame:
    """Visiting order of each route: (route, ord, visit), always the nearest stop left, the earliest among equals.

    A greedy tour is sequential within its route, so a route is one group of a grouped map and routes run in parallel. A
    stop without coordinates is never the nearest; once only such are left they follow in their order.
    """

    def tour(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(ord, kind="stable")
        out = greedy_tour(np.radians(g["latitude"].to_numpy(float)), np.radians(g["longitude"].to_numpy(float)), (float(np.radians(start[0])), float(np.radians(start[1]))))
        return pd.DataFrame({route: key[0], ord: g[ord].to_numpy()[out], "visit": np.arange(1, len(out) + 1)})

    kinds = dict(stops.dtypes)
    return stops.select(route, ord, "latitude", "longitude").groupBy(route).applyInPandas(tour, f"{route} {kinds[route]}, {ord} {kinds[ord]}, visit long")


def swap(stops: DataFrame, index: int, step: int, ord: str = "ord", n: str = "n") -> DataFrame:
    """Ordinals (from 0) after a stop and its neighbour changed places; out of range nothing changes. ``n``: stops of the route."""
    other = index + step
    fits = (F.lit(min(index, other)) >= 0) & (F.lit(max(index, other)) < F.col(n))
    return stops.withColumn(ord, F.when(fits & (F.col(ord) == index), other).when(fits & (F.col(ord) == other), index).otherwise(F.col(ord)))


def _coordinate(address: Column, offset: int) -> tuple[Column, Column]:
    seed = code_unit_sum(F.concat(address, F.lit(f":{offset}")))
    return F.round(F.lit(37.45) + ((seed + offset * 17) % 130) / 1000.0, 6), F.round(F.lit(126.85) + ((seed + offset * 23) % 250) / 1000.0, 6)


def address_candidates(df: DataFrame, address: str, district: str, noise: str = ADDRESS_NOISE, regions: str = REGIONS, detail: str = ADDRESS_DETAIL) -> DataFrame:
    """Adds status, warnings and one or two candidates (id, display, latitude, longitude, confidence, district, source).

    ``district`` is the column with the configured district found in the address, if any.
    """
    a = squeeze(F.coalesce(F.col(address), F.lit("")))
    # messages as callers know them (fixed values)
    texts = {"missing": "주소가 없습니다.", "noise": "주소에 라벨·전화번호가 섞여 있어 직접 확인이 필요합니다.", "poor": "주소의 지역·도로·건물 정보가 부족합니다.", "district": "등록된 배송 지역과 매칭되지 않았습니다."}
    none = F.array().cast("array<string>")
    mixed = a.rlike(noise)
    w = F.filter(F.array(F.when(~(a.rlike(regions) & a.rlike(detail)), texts["poor"]), F.when(F.col(district).isNull(), texts["district"])), lambda x: x.isNotNull())
    warnings = F.when(a == "", F.array(F.lit(texts["missing"]))).when(mixed, F.array(F.lit(texts["noise"]))).otherwise(w)

    def candidate(i: int, shown: Column, confidence: Column, source: str) -> Column:
        lat, lon = _coordinate(a, i)
        return F.struct(
            F.concat(F.lit(f"addr-{i}-"), F.lower(F.conv(code_unit_sum(a).cast("string"), 10, 36))).alias("id"), shown.alias("display"), lat.alias("latitude"), lon.alias("longitude"),
            confidence.alias("confidence"), F.col(district).alias("district"), F.lit(source).alias("source"),
        )

    first = candidate(0, a, F.when(F.size(w) > 0, 65).otherwise(82), "ocr")
    second = candidate(1, F.concat(a, F.lit(" (수동 확인 필요)")), F.lit(55), "manual")
    kind = "array<struct<id:string,display:string,latitude:double,longitude:double,confidence:int,district:string,source:string>>"
    found = F.when((a == "") | mixed, F.array().cast(kind)).when(F.size(w) > 0, F.array(first, second).cast(kind)).otherwise(F.array(first).cast(kind))
    return df.withColumn("status", F.when(a == "", "missing").when(mixed, "needsReview").otherwise("candidate")).withColumn("warnings", F.coalesce(warnings, none)).withColumn("candidates", found)


def select_candidate(df: DataFrame, chosen: Column) -> DataFrame:
    """Marks a candidate as selected and the address verified; an unknown id changes nothing."""
    there = F.exists("candidates", lambda c: c["id"] == chosen)
    return df.withColumn("selected", F.when(there, chosen)).withColumn("status", F.when(there, "verified").otherwise(F.col("status")))


def apply_selected(orders: DataFrame, verified: DataFrame) -> DataFrame:
    """Orders (id, address, latitude, longitude) with the place of the chosen candidate (id, candidates, selected), if any."""
    chosen = verified.where("selected is not null").select("id", F.get(F.filter("candidates", lambda c: c["id"] == F.col("selected")), 0).alias("_c"))
    j = orders.join(chosen, "id", "left")
    place = lambda name, field: F.when(F.col("_c").isNotNull(), F.col("_c")[field]).otherwise(F.col(name))
    return j.withColumns({"address": place("address", "display"), "latitude": place("latitude", "latitude"), "longitude": place("longitude", "longitude")}).drop("_c")


def trusted_destination(address: Column, latitude: Column, longitude: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x)
    return F.coalesce((address != "") & finite(latitude) & finite(longitude), F.lit(False))


def navigation_link(app: Column, latitude: Column, longitude: Column, name: Column) -> Column:
    """Deep link of a navigation app, null without usable coordinates."""
    ok = latitude.between(-90, 90) & longitude.between(-180, 180) & ~((latitude == 0) & (longitude == 0))
    at = F.concat_ws(",", latitude.cast("string"), longitude.cast("string"))
    label = F.replace(F.url_encode(F.coalesce(name, F.lit(""))), F.lit("+"), F.lit("%20"))
    return F.when(
        ok,
        F.when(app == "tmap", F.concat(F.lit("tmap://route?goalx="), longitude.cast("string"), F.lit("&goaly="), latitude.cast("string"), F.lit("&goalname="), label))
        .when(app == "naver", F.concat(F.lit("nmap://route/car?dlat="), latitude.cast("string"), F.lit("&dlng="), longitude.cast("string"), F.lit("&dname="), label))
        .otherwise(F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), F.url_encode(at))),
    )
