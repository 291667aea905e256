"""The registered queries as SQL for an independent engine."""

from __future__ import annotations

from ..functions import fragility as fr
from ..functions import geo, hazard
from ..functions import ground_motion as gm

R, A, B, E2 = geo.EARTH_RADIUS_M, geo.WGS84_A, geo.WGS84_B, geo.WGS84_E2
LN10 = "2.302585092994046"


def horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}*{x}+{c!r})"
    return out


def norm_cdf(x: str) -> str:
    a = f"abs({x})"
    near = f"exp(-{a}*{a}/2)*{horner(a, fr._TOP)}/{horner(a, fr._BOTTOM)}"
    far = f"exp(-{a}*{a}/2)/({a}+1/({a}+2/({a}+3/({a}+4/({a}+0.65)))))/2.506628274631"
    tail = f"(CASE WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {a} > 37 THEN (CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END) WHEN {x} > 0 THEN 1-{tail} ELSE {tail} END)"


def great_circle(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"(pow(sin(radians({lat2}-({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-({lon1}))/2),2))"
    return f"(2*{R}*atan2(sqrt({h}),sqrt(1-{h})))"


MAGS = """SELECT l_orderkey AS event_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx,
  l_quantity/10 AS size, l_returnflag AS type, l_linestatus AS code, l_linenumber=1 AS prime FROM lineitem"""
LOCS = "SELECT o_orderkey AS event_id, 12+o_custkey%400/100.0::DOUBLE AS lon, 45+o_orderkey%300/100.0::DOUBLE AS lat, (o_orderkey%30)::DOUBLE AS depth, o_orderdate AS ts FROM orders"
SITES = "SELECT c_custkey AS asset_id, 12+c_custkey%400/100.0::DOUBLE AS lon, 45+c_custkey%300/100.0::DOUBLE AS lat FROM customer"
#: Orders have one location each; an event is in the catalogue if it has a magnitude too.
CAT = f"""WITH m AS ({MAGS}), l AS ({LOCS}), p AS (
  SELECT event_id, size, type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prime DESC, idx DESC) AS n FROM m) WHERE n=1),
  c AS (SELECT event_id, p.size, p.type, lon, lat, depth, ts FROM p JOIN l USING (event_id))"""
WAVE = """WITH w AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts)-1 AS i, epoch_us(ts)/1e6 AS t, value-245 AS v FROM events)"""


def _area(value: str) -> str:
    return f"((sum(({value})::DECIMAL(28,10))::DOUBLE-(min_by({value},i)+max_by({value},i))/2)*0.01::DOUBLE)"


def _oscillators() -> str:
    """Newmark's steps, one sample after the other."""
    return f"""WITH RECURSIVE w AS ({WAVE.removeprefix("WITH w AS (")[:-1]}),
      o AS (SELECT p, 4*pi()*0.05::DOUBLE/p AS c, pow(2*pi()/p,2) AS k FROM (SELECT unnest([0.1,0.5,1.0])::DOUBLE AS p)),
      z(sid, p, c, k, i, d, v, a) AS (SELECT sid, p, c, k, i, 0.0::DOUBLE, 0.0::DOUBLE, -v::DOUBLE FROM w, o WHERE i=0
        UNION ALL SELECT sid, p, c, k, i, nd, 2*(nd-d)/0.01::DOUBLE-v, 4*(nd-d-v*0.01::DOUBLE)/0.0001::DOUBLE-a FROM (
          SELECT z.sid, p, c, k, w.i, d, z.v, a, (-w.v+d*(40000+2*c/0.01::DOUBLE)+z.v*(400+c)+a)/(k+2*c/0.01::DOUBLE+40000) AS nd FROM z JOIN w ON w.sid=z.sid AND w.i=z.i+1))
      SELECT sid, p AS period, round(max(abs(d)),5) AS sd, round(max(abs(v)),5) AS sv, round(max(abs(c*v+k*d)),5) AS sa, round(2*pi()/p*max(abs(d)),5) AS psv, round(pow(2*pi()/p,2)*max(abs(d)),5) AS psa FROM z GROUP BY sid, p"""


def _low_pass() -> str:
    """A filter of second order as its difference equation."""
    t = "tan(pi()*10*0.01::DOUBLE)"
    return f"""WITH RECURSIVE w AS ({WAVE.removeprefix("WITH w AS (")[:-1]}),
      q AS (SELECT t*t/n AS b, 2*(t*t-1)/n AS a1, (1-sqrt(2)*t+t*t)/n AS a2 FROM (SELECT {t} AS t, 1+sqrt(2)*{t}+{t}*{t} AS n)),
      z(sid, i, x1, x2, y1, y2) AS (SELECT sid, i, v::DOUBLE, 0.0::DOUBLE, b*v, 0.0::DOUBLE FROM w, q WHERE i=0
        UNION ALL SELECT z.sid, w.i, w.v, x1, b*(w.v+2*x1+x2)-a1*y1-a2*y2, y1 FROM z JOIN w ON w.sid=z.sid AND w.i=z.i+1, q)
      SELECT sid, i AS k, round(y1,6) AS y FROM z"""


def _gm(km: str) -> str:
    c = gm.BRAGATO_SLEJKO_PGA
    return f"(({c['a']}+({c['b']}+({c['c']})*5.5)*5.5+({c['d']}+{c['e']}*5.5*5.5*5.5)*log10(sqrt({km}*{km}+{c['h']}*{c['h']})))*{LN10})"


KM = f"({great_circle('lon', 'lat', '13.0', '46.0')}/1000)"
SIGMA = f"({gm.BRAGATO_SLEJKO_PGA['s']}::DOUBLE*{LN10})"
Z = f"(ln(median/theta)/sqrt(beta*beta+{SIGMA}*{SIGMA}))"
FRAG = """SELECT r_regionkey AS model_id, k AS level_ord, 0.05*(k+r_regionkey/4) AS theta, 0.5+0.05*r_regionkey AS beta FROM region, (SELECT unnest(range(1,6)) AS k)"""


def impact(weight: str, tail: str) -> str:
    return f"""WITH a AS (SELECT asset_id, exp({_gm(KM)}) AS median FROM ({SITES})),
    ty AS (SELECT o_custkey AS asset_id, p_brand AS taxonomy, sum(l_quantity) AS n FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey GROUP BY ALL),
    tm AS (SELECT p_brand AS taxonomy, (regexp_extract(p_brand,'([0-9]+)',1)::INT+j)%5 AS model_id, CASE j WHEN 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS weight
           FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand NOT LIKE '%5'), (SELECT unnest([0,1]) AS j)),
    f AS ({FRAG}),
    z AS (SELECT asset_id, model_id, level_ord, {Z} AS z FROM a, f),
    e AS (SELECT asset_id, model_id, level_ord, min(least(1.0,greatest(0.0,{norm_cdf('z')}))) OVER (PARTITION BY asset_id, model_id ORDER BY level_ord) AS poe FROM z),
    s AS (SELECT asset_id, model_id, level_ord, greatest(0.0, coalesce(lag(poe) OVER o, 1.0)-poe) AS p FROM e WINDOW o AS (PARTITION BY asset_id, model_id ORDER BY level_ord)
          UNION ALL SELECT asset_id, model_id, 6, poe FROM e WHERE level_ord=5),
    t AS (SELECT asset_id, taxonomy, n, level_ord, sum(p*weight)/sum(weight) AS p FROM ty JOIN tm USING (taxonomy) JOIN s USING (asset_id, model_id) GROUP BY ALL),
    x AS (SELECT asset_id, level_ord, CASE level_ord WHEN 6 THEN 'GT_LAST' ELSE 'D'||level_ord END AS level, sum(p*{weight})/sum({weight}) AS prob, sum(p*n) AS expected FROM t GROUP BY asset_id, level_ord)
    {tail}"""


def _filter(symbol: str, keep: bool = False, limit: str = "2.5") -> str:
    tail = "" if keep else " WHERE n > 0"
    return f"{CAT} SELECT * FROM (SELECT event_id, count(*) FILTER (WHERE m.size {symbol} {limit}) AS n FROM m JOIN c USING (event_id) GROUP BY event_id){tail}"


def _xyz(lon: str, lat: str, h: str) -> tuple[str, str, str]:
    n = f"({A}/sqrt(1-{E2}*pow(sin(radians({lat})),2)))"
    return f"(({n}+{h})*cos(radians({lat}))*cos(radians({lon})))", f"(({n}+{h})*cos(radians({lat}))*sin(radians({lon})))", f"(({n}*{1 - E2}+{h})*sin(radians({lat})))"


def _ball(lon: str, lat: str, h: str) -> tuple[str, str, str]:
    return f"(({h}+{R})*cos(radians({lat}))*cos(radians({lon})))", f"(({h}+{R})*cos(radians({lat}))*sin(radians({lon})))", f"(({h}+{R})*sin(radians({lat})))"


def _apart(p: tuple, q: tuple) -> str:
    return "sqrt(" + "+".join(f"pow({a}-{b},2)" for a, b in zip(p, q)) + ")"


def _distances() -> str:
    to = ("13.25::DOUBLE", "46.1::DOUBLE")
    dot = f"(sin(radians(lat))*sin(radians({to[1]}))+cos(radians(lat))*cos(radians({to[1]}))*cos(radians({to[0]}-lon)))"
    d = f"radians({to[0]}-lon)"
    az = f"atan2(sin({d})*cos(radians({to[1]})), cos(radians(lat))*sin(radians({to[1]}))-sin(radians(lat))*cos(radians({to[1]}))*cos({d}))"
    here = ("lon", "lat", "(-depth*1000)")
    return f"""SELECT event_id, round({great_circle('lon', 'lat', *to)},3) AS great_circle, round(2*{R}*sin(acos(greatest(-1.0,least(1.0,{dot})))/2),2) AS chord,
      round({_apart(_xyz(*here), _xyz(*to, '0.0'))},3) AS ellipsoid, round({_apart(_ball(*here), _ball(*to, '0.0'))},3) AS sphere,
      round((degrees({az})+360)-floor((degrees({az})+360)/360)*360,6) AS azimuth FROM ({LOCS})"""


def _projections() -> str:
    dx, dy, dz = (f"({a}-{b})" for a, b in zip(_xyz("lon", "lat", "0.0"), _xyz("13.0::DOUBLE", "46.0::DOUBLE", "0.0")))
    so, co, sa, ca = "sin(radians(13.0))", "cos(radians(13.0))", "sin(radians(46.0))", "cos(radians(46.0))"
    e2, e4, e6 = E2, E2**2, E2**3
    prime = e2 / (1 - e2)
    phi, lam = "radians(lat)", "radians(lon-((floor((lon+180)/6)+1)*6-183))"
    n, t, c, a = f"({A}/sqrt(1-{e2}*pow(sin({phi}),2)))", f"pow(tan({phi}),2)", f"({prime}*pow(cos({phi}),2))", f"(cos({phi})*{lam})"
    m = f"({A}*({1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256}*{phi}-{3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024}*sin(2*{phi})+{15 * e4 / 256 + 45 * e6 / 1024}*sin(4*{phi})-{35 * e6 / 3072}*sin(6*{phi})))"
    east = f"0.9996*{n}*({a}+(1-{t}+{c})*pow({a},3)/6+(5-18*{t}+{t}*{t}+72*{c}-{58 * prime})*pow({a},5)/120)+500000"
    north = f"0.9996*({m}+{n}*tan({phi})*(pow({a},2)/2+(5-{t}+9*{c}+4*{c}*{c})*pow({a},4)/24+(61-58*{t}+{t}*{t}+600*{c}-{330 * prime})*pow({a},6)/720))"
    cs, sn = f"cos({phi})", f"sin({phi})"
    radius = f"sqrt((pow({A**2}*{cs},2)+pow({B**2}*{sn},2))/(pow({A}*{cs},2)+pow({B}*{sn},2)))"
    return f"""SELECT asset_id, round({R}*radians(lon)*cos({phi}),3) AS x, round({R}*{phi},3) AS y, round(-{so}*{dx}+{co}*{dy},3) AS e,
      round(-{sa}*{co}*{dx}-{sa}*{so}*{dy}+{ca}*{dz},3) AS n, round({ca}*{co}*{dx}+{ca}*{so}*{dy}+{sa}*{dz},3) AS u, round({east},3) AS east, round({north},3) AS north,
      round({radius},3) AS radius, round((lon*40+180)-floor((lon*40+180)/360)*360-180,6) AS lon FROM ({SITES})"""


def _polygon(ring: tuple) -> str:
    pairs = list(zip(ring, ring[1:] + ring[:1]))
    hits = "+".join(f"(lat>{min(p[1], q[1])} AND lat<={max(p[1], q[1])} AND lon<=(lat-{p[1]})*({q[0]}-{p[0]})/({q[1]}-{p[1]})+{p[0]})::INT" for p, q in pairs)
    at = lambda p: (f"({R}*radians({p[0]}::DOUBLE)*cos(radians({p[1]}::DOUBLE)))", f"({R}*radians({p[1]}::DOUBLE))")
    area = "+".join(f"({at(p)[0]}*{at(q)[1]}-{at(q)[0]}*{at(p)[1]})" for p, q in pairs)
    return f"SELECT asset_id, round(abs({area})/2/1e6,3) AS area FROM ({SITES}) WHERE ({hits})%2=1"


def _style(column: str, table: dict, k: int) -> str:
    return f"(CASE {column}%4 WHEN 0 THEN {table['normal'][k]} WHEN 1 THEN {table['reverse'][k]} WHEN 2 THEN {table['strike-slip'][k]} ELSE {table['generic'][k]} END)"


def _correlation(t1: str, t2: str) -> str:
    lo, hi = f"least({t1},{t2})", f"greatest({t1},{t2})"
    c1 = f"(1-cos(pi()/2-0.366*ln({hi}/greatest({lo},0.109))))"
    c2 = f"(CASE WHEN {hi}<0.2 THEN 1-0.105*(1-1/(1+exp(100*{hi}-5)))*({hi}-{lo})/({hi}-0.0099) ELSE 0.0 END)"
    c3 = f"(CASE WHEN {hi}<0.109 THEN {c2} ELSE {c1} END)"
    c4 = f"({c1}+0.5*(sqrt({c3})-{c3})*(1+cos(pi()*{lo}/0.109)))"
    return f"(CASE WHEN {hi}<=0.109 THEN {c2} WHEN {lo}>0.109 THEN {c1} WHEN {hi}<0.2 THEN least({c2},{c4}) ELSE {c4} END)"


def _cum(value: str, delta: float) -> str:
    return f"c AS (SELECT sid, i, sum(CASE WHEN i=0 THEN 0.0 ELSE (x+px)/2*{delta} END) OVER (PARTITION BY sid ORDER BY i) AS cum FROM (SELECT sid, i, {value} AS x, lag({value}) OVER (PARTITION BY sid ORDER BY i) AS px FROM w))"


PROFILES = """WITH l AS (SELECT * FROM (SELECT p_brand||'/'||(n-1)//6 AS site, (n-1)%6+1 AS k, p_size::DOUBLE AS hl, 100+p_retailprice/4 AS vs FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part))),
  g AS (SELECT *, 10.0+k AS qs, 1800.0+50*k AS dn, sum(hl) OVER (PARTITION BY site ORDER BY k)-hl AS top, k=max(k) OVER (PARTITION BY site) AS base,
        sum(hl/vs) OVER (PARTITION BY site ORDER BY k)-hl/vs AS tt FROM l),
  h AS (SELECT *, max(CASE WHEN base THEN top END) OVER (PARTITION BY site) AS rock FROM g)"""


def _mean(value: str, depth: str) -> str:
    return f"(sum(greatest(0.0,CASE WHEN base THEN {depth}-top ELSE least(top+hl,{depth})-top END)*{value})/{depth})"


def _parameters() -> str:
    v30 = f"(1/{_mean('(1/vs)', '30.0')})"
    edge = lambda c, k: f"max(CASE WHEN {k} THEN {c} END)"
    top = lambda c: edge(c, "k=1")
    rock = lambda c: edge(c, "base")
    kappa = "sum(CASE WHEN base THEN 0 ELSE hl/(vs*qs) END)"
    return f"""{PROFILES}, s AS (SELECT site, {v30} AS v, {_mean('vs', '50.0')} AS vs50, {kappa} AS kappa, sqrt({rock('dn')}*{rock('vs')}/({top('dn')}*{top('vs')})) AS amp,
      sum(vs*CASE WHEN base THEN greatest(0.0,0.25-tt) ELSE greatest(0.0,least(hl/vs,0.25-tt)) END) AS qwl FROM h GROUP BY site)
      SELECT site, round(v,6) AS vs30, round(vs50,6) AS vs50, round(kappa,9) AS kappa, CASE WHEN v>=800 THEN 'A' WHEN v>=360 THEN 'B' WHEN v>=180 THEN 'C' ELSE 'D' END AS ec8,
      CASE WHEN v>=1500 THEN 'A' WHEN v>=760 THEN 'B' WHEN v>=360 THEN 'C' WHEN v>=180 THEN 'D' ELSE 'E' END AS nehrp, round(amp,6) AS amplification, round(qwl,6) AS qwl, round(exp(-pi()*kappa*5),6) AS decay FROM s"""


def _table(im: str, log: bool) -> str:
    points = ((10.0, 0.0), (50.0, 0.2), (200.0, 0.7), (400.0, 1.0))
    s = (lambda x: f"ln({x}::DOUBLE)") if log else (lambda x: f"({x})")
    inside = " ".join(f"WHEN {im}<{q[0]} THEN {p[1]}+({s(im)}-{s(p[0])})/({s(q[0])}-{s(p[0])})*({q[1]}-{p[1]})" for p, q in zip(points, points[1:]))
    return f"(CASE WHEN {im}<=10 THEN 0.0 {inside} ELSE 1.0 END)"


def oracle_sql() -> dict[str, str]:
    from .queries import RING

    m = "(s_suppkey%50/10.0::DOUBLE+3)"
    moment = f"pow(10.0,({m}+10.7)*1.5)"
    at = gm.ATKINSON_PGA
    km = great_circle("s.lon", "s.lat", "e.lon", "e.lat") + "/1000"
    near = "greatest(1.0,pow(10.0,-1.72+0.43*mag))"
    pga = f"exp(({at['c0']}+{at['c1']}*mag+({at['c2']})*mag*mag+({at['c3']})*log10(sqrt((km*km+100)+{near}*{near})))*{LN10}-ln(100*{gm.GRAVITY}))"
    completeness = "SELECT p_size/10 AS magnitude, 1900+p_partkey%80 AS year_start, 1950+p_partkey%70 AS year_end, p_size/50 AS completeness FROM part"
    poe = "+".join(f"{p}*({norm_cdf(f'(ln({x}/theta)/beta)')})" for x, p in ((0.05, 1.0), (0.1, 2.0), (0.3, 1.0)))
    seg = f"{WAVE}, g AS (SELECT *, CASE WHEN lag(t) OVER o IS NULL OR t-lag(t) OVER o>3600 THEN 1 ELSE 0 END AS nw FROM w WINDOW o AS (PARTITION BY sid ORDER BY t, i)), q AS (SELECT *, sum(nw) OVER (PARTITION BY sid ORDER BY t, i)::BIGINT AS segment FROM g), sg AS (SELECT sid, segment, min(t) AS \"begin\", max(t) AS \"end\", count(*) AS n FROM q GROUP BY sid, segment)"
    out = {
        "impact_summary": impact("n", "SELECT level, count(*) AS assets, round(sum(expected),3) AS expected FROM x GROUP BY level"),
        "impact_assets": impact("n", "SELECT asset_id, level, round(prob,6) AS prob, round(expected,4) AS expected FROM x"),
        "impact_uniform_mix": impact("1.0", "SELECT asset_id, level, round(prob,6) AS prob FROM x"),
        "impact_top10": impact("n", "SELECT asset_id, round(sum(expected),4) AS d5_tail FROM x WHERE level_ord>=5 GROUP BY asset_id ORDER BY d5_tail DESC, asset_id LIMIT 10"),
        "impact_typology_breakdown": impact("n", "SELECT asset_id, taxonomy, CASE level_ord WHEN 6 THEN 'GT_LAST' ELSE 'D'||level_ord END AS level, round(p,6) AS prob FROM t"),
        "impact_skip_taxonomy": impact("n", """SELECT asset_id, n_units, covered FROM (SELECT asset_id, sum(n) AS n_units FROM ty GROUP BY asset_id)
          JOIN (SELECT asset_id, round(sum(n),3) AS covered FROM ty WHERE taxonomy IN (SELECT taxonomy FROM tm) GROUP BY asset_id) USING (asset_id)"""),
        "gm_assets": f"SELECT asset_id, round(exp({_gm(KM)}),9) AS median, round({SIGMA},9) AS sigma FROM ({SITES})",
        "gm_events_near_sites": f"SELECT site_id, count(*) AS events, round(max({pga}),9) AS pga FROM (SELECT s.asset_id AS site_id, depth/10+3 AS mag, {km} AS km FROM ({LOCS}) e, ({SITES}) s) WHERE km<=15 GROUP BY site_id",
        "frag_distribution": f"SELECT model_id, 'D'||level_ord AS level, round(({poe})/4.0,9) AS poe FROM ({FRAG})",
        "frag_tabulated": f"SELECT event_id, round({_table('value', False)},6) AS poe, round({_table('value', True)},6) AS poe_log FROM events",
        "cat_prime": f"{CAT} SELECT event_id, size, type FROM c",
        "cat_filter_keep_empty": _filter(">", True, "4.5"),
        "cat_range": f"{CAT} SELECT min(size) AS low, max(size) AS high FROM c",
        "cat_values": f"{CAT} SELECT event_id, depth AS value FROM c",
        "cat_append_new": f"{CAT} SELECT event_id, count(*) AS n FROM m JOIN c USING (event_id) GROUP BY event_id",
        "cat_append_skipped": f"{CAT} SELECT event_id FROM c WHERE event_id%4=1",
        "cat_upsert": f"{CAT} SELECT event_id, count(*)*(CASE event_id%4 WHEN 1 THEN 2 ELSE 1 END) AS n, c.size FROM m JOIN c USING (event_id) GROUP BY event_id, c.size",
        "cat_sort": f"{CAT}, s AS (SELECT event_id, count(*) AS n, c.size FROM m JOIN c USING (event_id) GROUP BY event_id, c.size) SELECT *, row_number() OVER (ORDER BY size NULLS FIRST, event_id)-1 AS place FROM s",
        "haz_completeness_order": f"""WITH c AS ({completeness}), e AS (SELECT magnitude, year_start, year_end, round(completeness,9) AS completeness FROM c UNION ALL SELECT magnitude, year_start, year_start, round(completeness,9) FROM c WHERE magnitude=4.5)
          SELECT *, row_number() OVER (ORDER BY magnitude, year_start, year_end, completeness)-1 AS place, 'magnitude' AS "by" FROM e UNION ALL SELECT *, row_number() OVER (ORDER BY year_start, magnitude, year_end, completeness)-1, 'year' FROM e""",
        "cat_remove": f"{CAT} SELECT event_id, count(*) AS n, c.size FROM m JOIN c USING (event_id) WHERE event_id%5<>0 GROUP BY event_id, c.size",
        "cat_get_event": f"{CAT} SELECT event_id, count(*) AS n, c.size FROM m JOIN c USING (event_id) WHERE event_id%5=0 GROUP BY event_id, c.size",
        "cat_add_magnitude": f"{CAT} SELECT event_id, count(*)+(event_id%5=0)::INT AS n, CASE event_id%5 WHEN 0 THEN 9.5 ELSE c.size END::DOUBLE AS size FROM m JOIN c USING (event_id) GROUP BY event_id, c.size",
        "cat_remove_solution": f"{CAT} SELECT event_id, count(*) FILTER (WHERE event_id%5<>0 OR idx>1) AS n, round(coalesce(sum(m.size) FILTER (WHERE event_id%5<>0 OR idx>1),0)::DOUBLE,3) AS total FROM m JOIN c USING (event_id) GROUP BY event_id",
        "cat_hypocentre": f"{CAT} SELECT event_id, round(lon,6) AS lon, round(lat,6) AS lat, -depth*1000 AS elevation FROM c",
        "geo_distances": _distances(),
        "geo_from_enu": f"SELECT event_id, round(lon,6) AS lon, round(lat,6) AS lat, round(1-depth*1000,3) AS above FROM ({LOCS})",
        "geo_boxes": f"SELECT asset_id, round(lon,6) AS west, round(lat,6) AS south, round(lon+0.1::DOUBLE,6) AS east, round(lat+0.2::DOUBLE,6) AS north, round((lon+lon+0.1::DOUBLE+lon)/3,6) AS lon, round((lat+lat+lat+0.2::DOUBLE)/3,6) AS lat FROM ({SITES})",
        "geo_projections": _projections(),
        "geo_in_polygon": _polygon(RING),
        "haz_rates": f"""SELECT s_suppkey, round(1-exp(-(s_suppkey/1000.0::DOUBLE)*50.0),9) AS p, round(-ln(1-s_suppkey%90/100.0::DOUBLE)/50.0,9) AS rate,
            round(CASE WHEN {m}>7 THEN 0.0 ELSE pow(10.0,4.0)*(pow(10.0,-{m})-pow(10.0,-7.0)) END,9) AS gr, round(log10({moment})*(2.0/3.0)-10.7,6) AS mw,
            round(log10(s_suppkey+1.0)+1.11*log10(s_suppkey+10.0)+0.00189*(s_suppkey+10.0)-2.09,6) AS ml,
            round(log10(s_suppkey+1.0)+1.105*log10(s_suppkey+10.0)+147.111*log10((s_suppkey+10.0)*4.015e-5+1.33885)-18.0471,6) AS ml_hb FROM supplier""",
        "haz_scaling": f"SELECT p_partkey, round({_style('p_size', hazard.AREA_TO_MAGNITUDE, 0)}+{_style('p_size', hazard.AREA_TO_MAGNITUDE, 1)}*log10(p_retailprice),6) AS m, round({_correlation('(p_size/50+0.02)', '0.15')},6) AS rho FROM part",
        "haz_b_value": f"WITH m AS ({MAGS}), s AS (SELECT count(*) AS n, {0.4342944819032518}/(avg(size)-0.95) AS b FROM m WHERE size>=1.0) SELECT n, round(b,9) AS b, round(b/sqrt(n),9) AS b_sigma FROM s",
        "haz_histogram": f"WITH m AS ({MAGS}) SELECT round(floor((size-1.0)/0.5+1e-9)*0.5+1.25,6) AS m, count(*) AS n FROM m WHERE size>=1.0 GROUP BY 1",
        "haz_completeness_year": f"SELECT magnitude, count(*) AS n FROM ({completeness}) WHERE year_start<=1960 AND year_end>=1960 GROUP BY magnitude",
        "haz_completeness_magnitude": f"SELECT magnitude, year_start, count(*) AS n FROM ({completeness}) WHERE magnitude=2.5 GROUP BY magnitude, year_start",
        "haz_completeness_edit": f"""WITH c AS ({completeness}) SELECT magnitude, count(*) AS n, round(avg(completeness),6) AS completeness, sum(year_end)::BIGINT AS years FROM (
          SELECT magnitude, year_end, CASE WHEN year_start<1910 THEN 0.5 ELSE completeness END::DOUBLE AS completeness FROM c WHERE magnitude>=1
          UNION ALL SELECT magnitude, year_start, completeness FROM c WHERE magnitude=4.5) GROUP BY magnitude""",
        "haz_completeness_average": f"SELECT round(avg(completeness),9) AS completeness FROM ({completeness})",
        "noise_directions": """WITH s AS (SELECT l_suppkey AS sid, l_quantity::DOUBLE-20 AS xr, l_linenumber-3.0::DOUBLE AS xi, l_quantity::DOUBLE/2 AS yr, l_orderkey%7-2.0::DOUBLE AS yi FROM lineitem),
          t AS (SELECT sid, atan2(2*sum(xr*yr+xi*yi), sum(xr*xr+xi*xi-yr*yr-yi*yi))/2 AS theta FROM s GROUP BY sid)
          SELECT sid, round(theta,6) AS theta, round(sum(pow(xr*cos(theta)+yr*sin(theta),2)+pow(xi*cos(theta)+yi*sin(theta),2)),3) AS power FROM s JOIN t USING (sid) GROUP BY sid, theta""",
        "sig_demean": f"{WAVE} SELECT sid, i, round(v-avg(v) OVER (PARTITION BY sid),6) AS v FROM w",
        "sig_integral": f"{WAVE}, {_cum('v', 0.5)} SELECT sid, i, round(cum,4) AS integral FROM c",
        "sig_gradient": f"{WAVE} SELECT sid, i, round((CASE WHEN pv IS NULL THEN nv-v WHEN nv IS NULL THEN v-pv ELSE (nv-pv)/2 END)/0.5,6) AS slope FROM (SELECT *, lag(v) OVER o AS pv, lead(v) OVER o AS nv FROM w WINDOW o AS (PARTITION BY sid ORDER BY i))",
        "sig_peak": f"{WAVE} SELECT sid, round(a,6) AS peak, i FROM (SELECT sid, i, abs(v) AS a, row_number() OVER (PARTITION BY sid ORDER BY abs(v) DESC, i) AS n FROM w) WHERE n=1",
        "sig_intensity": f"""{WAVE}, x AS (SELECT sid, count(*) AS n, {_area("v*v")} AS e, {_area("abs(v)")} AS c FROM w GROUP BY sid)
            SELECT sid, round(e*pi()/(2*{gm.GRAVITY}),2) AS arias, round(c,3) AS cav, round(sqrt(e/nullif((n-1)*0.01::DOUBLE,0)),3) AS rms FROM x""",
        "sig_durations": f"""{WAVE}, {_cum('v*v', 0.01)}, t AS (SELECT *, max(cum) OVER (PARTITION BY sid) AS total FROM c), s AS (SELECT sid, min(i) FILTER (WHERE cum>=0.95*total)-min(i) FILTER (WHERE cum>=0.05*total) AS d FROM t WHERE total>0 GROUP BY sid)
            SELECT sid, round(any_value(d)*0.01::DOUBLE,6) AS significant, round(coalesce(max(i) FILTER (WHERE abs(v)>=200)-min(i) FILTER (WHERE abs(v)>=200),0)*0.01::DOUBLE,6) AS bracketed FROM w JOIN s USING (sid) GROUP BY sid""",
        "sig_moving_rms": f"{WAVE} SELECT sid, i, round(sqrt(sum(v*v) OVER (PARTITION BY sid ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)/7),4) AS rms FROM w",
        "sig_split_windows": f"{WAVE}, n AS (SELECT sid, count(*) AS n FROM w GROUP BY sid), s AS (SELECT sid, unnest(range(0,(n-16)//8+1)) AS w FROM n WHERE n>=16) SELECT sid, s.w, count(*) AS n, round(avg(v),6) AS mean FROM s JOIN w USING (sid) WHERE i>=s.w*8 AND i<s.w*8+16 GROUP BY sid, s.w",
        "sig_taper": f"{WAVE}, n AS (SELECT *, count(*) OVER (PARTITION BY sid)-1 AS n FROM w), x AS (SELECT *, least(i,n-i)/n AS x FROM n) SELECT sid, i, round(v*CASE WHEN x<0.1 THEN 0.5*(1-cos(2*pi()*x/0.2)) ELSE 1.0 END,6) AS v FROM x",
        "sig_segments": f"{seg} SELECT * FROM sg",
        "sig_later_wins": f"{WAVE} SELECT sid, floor(t/86400)::BIGINT AS cell, round(max_by(v,i),6) AS v, count(*) AS n FROM w GROUP BY sid, floor(t/86400)",
        "sig_cut": f"{WAVE} SELECT sid, i FROM w WHERE t BETWEEN 1704070000 AND 1704500000",
        "sig_overlaps": f"{seg} SELECT sid, count(*) AS records FROM sg WHERE \"begin\"<=1704500000 AND \"end\">=1704070000 GROUP BY sid",
        "sig_resonance": f"{WAVE} SELECT sid, count(*) AS peaks, min(i) AS first FROM (SELECT *, abs(v)>lag(abs(v)) OVER o AND abs(v)>lead(abs(v)) OVER o AS p FROM w WINDOW o AS (PARTITION BY sid ORDER BY i)) WHERE p GROUP BY sid",
        "resp_epoch_join": f"{WAVE} SELECT c_custkey AS stage, count(*) AS samples FROM w JOIN customer ON sid=c_custkey%150 AND t>=1704067200.0+c_custkey*600 AND t<1704067200.0+c_custkey*600+86400 GROUP BY c_custkey",
        "site_parameters": _parameters(),
        "site_log_statistics": "SELECT p_type AS site, round(exp(avg(ln(100+p_retailprice/4))),6) AS mean, round(exp(stddev_pop(ln(100+p_retailprice/4))),6) AS deviation FROM part GROUP BY p_type",
        "time_parts": """SELECT o_orderkey, epoch_us(o_orderdate)/1e6+62135596800 AS seconds, dayofyear(o_orderdate) AS day, strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S.%g')||'Z' AS iso,
            year(o_orderdate)%4=0 AND (year(o_orderdate)%100<>0 OR year(o_orderdate)%400=0) AS leap, epoch_us(o_orderdate)/1e6+62135596800+172800 AS later, true AS back FROM orders""",
    }
    out["mesh_cells"] = f"""WITH s AS ({SITES}), b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM s),
        n AS (SELECT floor((lon-x0)/0.25+1e-9)::BIGINT AS x, floor((lat-y0)/0.25+1e-9)::BIGINT AS y, count(*) AS n FROM s, b GROUP BY ALL),
        g AS (SELECT x, y, floor((x1-x0)/0.25+1e-12)::BIGINT+1 AS nx FROM b, LATERAL (SELECT unnest(range(floor((x1-x0)/0.25+1e-12)::BIGINT+1)) AS x), LATERAL (SELECT unnest(range(floor((y1-y0)/0.25+1e-12)::BIGINT+1)) AS y))
        SELECT y*nx+x AS id, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (x, y)"""
    # of all triples of stations around a site, the one of least weighted mean squared distance is its triangle
    out["gm_scattered"] = f"""WITH s AS ({SITES}), p AS (SELECT DISTINCT lon, lat FROM s),
      n AS (SELECT lon, lat, avg(a) AS a, avg(b) AS b, row_number() OVER (ORDER BY lon, lat) AS i FROM (SELECT 12+s_suppkey*157%400/100.0::DOUBLE AS lon, 45+s_suppkey*211%300/100.0::DOUBLE AS lat, s_acctbal AS a, CASE WHEN s_suppkey%7<>0 THEN s_suppkey::DOUBLE END AS b FROM supplier) GROUP BY lon, lat),
      t AS (SELECT u.lon AS x0, u.lat AS y0, v.lon AS x1, v.lat AS y1, w.lon AS x2, w.lat AS y2, u.a AS a0, v.a AS a1, w.a AS a2, u.b AS b0, v.b AS b1, w.b AS b2, (v.lon-u.lon)*(w.lat-u.lat)-(w.lon-u.lon)*(v.lat-u.lat) AS area FROM n u JOIN n v ON u.i<v.i JOIN n w ON v.i<w.i),
      k AS (SELECT p.lon, p.lat, t.*, ((x1-p.lon)*(y2-p.lat)-(x2-p.lon)*(y1-p.lat))/area AS w0, ((x2-p.lon)*(y0-p.lat)-(x0-p.lon)*(y2-p.lat))/area AS w1 FROM p JOIN t ON abs(area)>1e-9 AND p.lon>=least(x0,x1,x2)-1e-9 AND p.lon<=greatest(x0,x1,x2)+1e-9 AND p.lat>=least(y0,y1,y2)-1e-9 AND p.lat<=greatest(y0,y1,y2)+1e-9),
      c AS (SELECT *, 1-w0-w1 AS w2, {"+".join(f"{w}*((x{j}-lon)*(x{j}-lon)+(y{j}-lat)*(y{j}-lat)+1e-7*(x{j}-lon)*(y{j}-lat))" for j, w in enumerate(("w0", "w1", "(1-w0-w1)")))} AS q FROM k WHERE w0>=-1e-10 AND w1>=-1e-10 AND w0+w1<=1+1e-10),
      f AS (SELECT lon, lat, arg_min({"+".join(f"CASE WHEN w{j}>1e-10 THEN a{j}*w{j} ELSE 0 END" for j in range(3))}, q) AS a, arg_min(struct_pack(v := {"+".join(f"CASE WHEN w{j}>1e-10 THEN b{j}*w{j} ELSE 0 END" for j in range(3))}), q).v AS b FROM c GROUP BY lon, lat)
      SELECT asset_id, round(a,5) AS a, round(b,5) AS b FROM s LEFT JOIN f USING (lon, lat)"""
    out["grid_interpolation"] = f"""WITH l AS ({LOCS}), g AS (SELECT floor(lon*4+1e-9)::BIGINT AS x, floor(lat*4+1e-9)::BIGINT AS y, avg(depth) AS v FROM l GROUP BY ALL),
        p AS (SELECT asset_id, floor(lon/0.25+1e-9)::BIGINT AS x, floor(lat/0.25+1e-9)::BIGINT AS y, lon/0.25 AS a, lat/0.25 AS b FROM ({SITES}))
        SELECT asset_id, round((1-(a-p.x))*(1-(b-p.y))*g0.v+(a-p.x)*(1-(b-p.y))*g1.v+(1-(a-p.x))*(b-p.y)*g2.v+(a-p.x)*(b-p.y)*g3.v,6) AS value FROM p
        LEFT JOIN g g0 ON g0.x=p.x AND g0.y=p.y LEFT JOIN g g1 ON g1.x=p.x+1 AND g1.y=p.y LEFT JOIN g g2 ON g2.x=p.x AND g2.y=p.y+1 LEFT JOIN g g3 ON g3.x=p.x+1 AND g3.y=p.y+1"""
    out["exposure_group_by"] = """SELECT p_brand AS asset_id, min_by(p_size/10, p_partkey) FILTER (WHERE p_size>10) AS lon, min_by(p_size/5, p_partkey) FILTER (WHERE p_size>10) AS lat,
        count(*)>1 OR max(p_size%3)>1 AS aggregated, count(*) AS n, max_by(p_type, p_partkey) AS last FROM part GROUP BY p_brand"""
    out["geo_polygon_samples"] = f"SELECT asset_id, asset_id%40+1 AS n, asset_id%40+1 AS \"within\", 0 AS in_hole FROM ({SITES})"
    out["resp_transfer"] = """WITH x AS (SELECT s_suppkey AS sid, f AS freq, 2*pi()*f AS w, 2.0*(100+s_nationkey) AS g, 1.0+s_suppkey%50/10.0 AS pr, s_suppkey%7/2.0 AS pi_, 2*pi()*f/(20+s_suppkey%5) AS th FROM supplier, (SELECT unnest([0.5,2.0,10.0])::DOUBLE AS f)),
      y AS (SELECT sid, freq, g/sqrt(pr*pr+(w-pi_)*(w-pi_))*sqrt(pow(0.75+0.25*cos(th),2)+pow(0.25*sin(th),2)) AS a, atan2(-0.25*sin(th),0.75+0.25*cos(th))-atan2(w-pi_,pr) AS ph FROM x)
      SELECT sid, freq, round(a,9) AS amplitude, round(CASE WHEN ph<=-pi() THEN ph+2*pi() WHEN ph>pi() THEN ph-2*pi() ELSE ph END,9) AS phase FROM y"""
    keys = list(gm.BRAGATO_SLEJKO_PGA)
    known = ",".join("(" + ",".join([f"'{imt}'", *(f"{c[k]!r}::DOUBLE" for k in keys)]) + ")" for imt, c in gm.BRAGATO_SLEJKO_EPICENTRAL.items())
    out["gm_measures"] = f"""WITH t(imt,{','.join(keys)}) AS (VALUES {known}), x AS (SELECT asset_id, {KM} AS km FROM ({SITES}))
      SELECT asset_id, imt, round((a+(b+c*5.5)*5.5+(d+e*pow(5.5,3))*log10(sqrt(km*km+h*h)))*{LN10}-CASE WHEN imt='PGV' THEN ln(100.0) ELSE 0.0 END,7) AS ln_mean, round(s*{LN10},7) AS sigma FROM x, t"""
    out["exposure_taxonomies"] = "SELECT DISTINCT p_brand AS taxonomy FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey"
    out["exposure_branches"] = impact("n", """SELECT taxonomy, model_id, count(*) AS assets, sum(k)::BIGINT AS units FROM (SELECT taxonomy, model_id, floor(n*weight+1e-9)::BIGINT AS k FROM ty JOIN tm USING (taxonomy)) WHERE k>0 GROUP BY ALL""")
    tone = lambda k: f"CASE WHEN max(n)>={2 * k} THEN round((pow(sum(v*cos(2*pi()*{k}*i/n)),2)+pow(sum(v*sin(2*pi()*{k}*i/n)),2))*0.25,3) END AS p{k}"
    out["sig_spectrum"] = f"{WAVE}, d AS (SELECT sid, i, v-avg(v) OVER o AS v, count(*) OVER o AS n FROM w WINDOW o AS (PARTITION BY sid)) SELECT sid, {tone(1)}, {tone(2)}, {tone(3)} FROM d GROUP BY sid"
    out["sig_response_spectrum"] = _oscillators()
    out["sig_causal_filter"] = _low_pass()
    out["stream_tumbling"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS \"begin\", user_id AS sid, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL"
    out["stream_sliding"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts)-k*INTERVAL 1 HOUR AS \"begin\", user_id AS sid, count(*) AS n, round(sum(value),4) AS total FROM events, (SELECT unnest([0,1]) AS k) GROUP BY ALL"
    out["stream_segments"] = """WITH g AS (SELECT user_id AS sid, ts, CASE WHEN lag(ts) OVER o IS NULL OR ts-lag(ts) OVER o>INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(nw) OVER (PARTITION BY sid ORDER BY ts) AS k FROM g) SELECT min(ts) AS "begin", max(ts) AS "end", sid, count(*) AS n FROM s GROUP BY sid, k"""
    out["stream_ring_buffer"] = """WITH x AS (SELECT user_id AS sid, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events)
        SELECT sid, count(*) AS n, round(min_by(value,k),6) AS last, round(max_by(value,k),6) AS first FROM x WHERE k<=5 GROUP BY sid"""
    for name, symbol in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
        out[f"cat_filter_{name}"] = _filter(symbol)
    return out
