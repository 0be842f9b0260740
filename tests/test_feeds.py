"""Each feed's rules on known rows, one after the other as the rules stand, and rows without values."""

from pyspark.sql import functions as F

from tidewatch.functions import feedrules as FR
from tidewatch.operators import stateful as Z

KNOWN = [  # feed, text, status, code, measure, places, days, severity
    ("armed_conflict", "Protests", None, "", 60, None, None, "critical"), ("armed_conflict", "Protests", None, "", 12, None, None, "high"),
    ("armed_conflict", "Explosions/Remote violence", None, "Air/drone strike", 5, None, None, "critical"), ("armed_conflict", "Battles", None, "Armed clash", 0, None, None, "high"),
    ("armed_conflict", "Violence against civilians", None, "Sexual violence", 0, None, None, "critical"), ("armed_conflict", "Violence against civilians", None, "Attack", 1, None, None, "high"),
    ("armed_conflict", "Violence against civilians", None, "Attack", 0, None, None, "medium"), ("armed_conflict", "Riots", None, "", 0, None, None, "medium"), ("armed_conflict", "Protests", None, "Peaceful protest", 0, None, None, "low"),
    ("aircraft_squawks", None, "7500", None, None, None, None, "critical"), ("aircraft_squawks", None, "7600", None, None, None, None, "medium"), ("aircraft_squawks", None, "7700", None, None, None, None, "high"), ("aircraft_squawks", None, "1200", None, None, None, None, None),
    ("ship_distress", None, "14", None, None, None, None, "critical"), ("ship_distress", None, "7", None, None, None, None, "high"), ("ship_distress", None, "0", None, None, None, None, None),
    ("aviation_incidents", "glider", None, None, 50, None, None, "critical"), ("aviation_incidents", "Boeing crash", None, None, 10, None, None, "critical"), ("aviation_incidents", "glider", None, None, 10, None, None, "high"),
    ("aviation_incidents", "Military jet", None, None, 1, None, None, "high"), ("aviation_incidents", "glider", None, None, 2, None, None, "medium"), ("aviation_incidents", "hull loss", None, None, 0, None, None, "medium"), ("aviation_incidents", "near miss", None, None, 0, None, None, "low"),
    ("naval_groups", None, "deployment", None, None, None, None, "high"), ("naval_groups", None, "port_call", None, None, None, None, "medium"),
    ("satellites", None, "overview", None, None, None, None, "info"), ("satellites", None, "launch", None, None, None, None, "medium"),
    ("exploited_flaws", "Acme", "Known", None, None, None, 90, "critical"), ("exploited_flaws", "Palo Alto Networks", "Unknown", None, None, None, 90, "critical"), ("exploited_flaws", "Acme", "Unknown", None, None, None, 14, "high"),
    ("exploited_flaws", "Acme", "Unknown", None, None, None, 15, "medium"), ("exploited_flaws", "Acme", "Unknown", None, None, None, 31, "low"), ("exploited_flaws", "Acme", "Unknown", None, None, None, -3, "high"),
    ("commodity_flows", None, "2844", None, 1e7, None, None, "critical"), ("commodity_flows", None, "1001", None, 1e10, None, None, "high"), ("commodity_flows", None, "1001", None, 1.1e10, None, None, "critical"),
    ("commodity_flows", None, "8542", None, 2e7, None, None, "high"), ("commodity_flows", None, "1001", None, 1e8, None, None, "low"), ("commodity_flows", None, "1001", None, 2e8, None, None, "medium"), ("commodity_flows", None, "2844", None, 9e6, None, None, None), ("commodity_flows", None, "2844", None, None, None, None, None),
    ("union_sanctions", "Measures against Belarus", None, None, None, None, None, "critical"), ("union_sanctions", "ARMS EMBARGO", None, None, None, None, None, "high"), ("union_sanctions", "Tunisia", None, None, None, None, None, "medium"), ("union_sanctions", "other", None, None, None, None, None, "low"),
    ("fires", None, None, None, 1000, None, None, "critical"), ("fires", None, None, None, 400, None, None, "high"), ("fires", None, None, None, 100, None, None, "medium"), ("fires", None, None, None, 99, None, None, "low"),
    ("navigation_jamming", None, "spoofing", None, 0.5, None, None, "critical"), ("navigation_jamming", None, "military", None, 0.92, None, None, "critical"), ("navigation_jamming", None, "military", None, 0.75, None, None, "high"),
    ("navigation_jamming", None, "civilian", None, 0.5, None, None, "medium"), ("navigation_jamming", None, "unknown", None, 0.85, None, None, "high"), ("navigation_jamming", None, "unknown", None, 0.65, None, None, "medium"), ("navigation_jamming", None, "unknown", None, 0.6, None, None, "low"), ("navigation_jamming", None, "spoofing", None, 0.4, None, None, None),
    ("volcanoes", None, "NORMAL", "RED", None, None, None, "critical"), ("volcanoes", None, "WATCH", "YELLOW", None, None, None, "high"), ("volcanoes", None, "ADVISORY", "green", None, None, None, "medium"), ("volcanoes", None, None, "yellow", None, None, None, "medium"), ("volcanoes", None, "UNASSIGNED", None, None, None, None, "low"),
    ("nuclear_events", "INES Level 5 accident", None, None, None, None, None, "critical"), ("nuclear_events", "Lost source found", None, None, None, None, None, "high"), ("nuclear_events", "tritium leak", None, None, None, None, None, "medium"), ("nuclear_events", "meeting", None, None, None, None, None, "low"),
    ("wanted_notices", "Terrorism", None, None, None, 1, None, "critical"), ("wanted_notices", "Murder", None, None, None, 1, None, "high"), ("wanted_notices", "fraud", None, None, None, 3, None, "high"), ("wanted_notices", "fraud", None, None, None, 2, None, "medium"), ("wanted_notices", "fraud", None, None, None, 1, None, "low"),
    ("internet_outages", None, None, None, 500, None, None, "critical"), ("internet_outages", None, None, None, 30, None, None, "medium"), ("internet_outages", None, None, None, 29, None, None, None),
    ("markets", None, "volatility", None, 30, None, None, "high"), ("markets", None, "index", None, 6, None, None, "critical"), ("markets", None, "crypto", None, 99, None, None, "high"), ("markets", None, "commodity", None, 5, None, None, "medium"), ("markets", None, "index", None, 1.9, None, None, "low"),
    ("storms", "Tornado Warning", "Minor", "Future", None, None, None, "critical"), ("storms", "Red Flag Warning", "Minor", "Future", None, None, None, "high"), ("storms", "Dust", "Severe", "Immediate", None, None, None, "critical"), ("storms", "Dust", "Moderate", "Immediate", None, None, None, "high"),
    ("storms", "Dust", "Minor", "Immediate", None, None, None, "low"), ("storms", "Dust", "Severe", "Expected", None, None, None, "high"), ("storms", "Dust", "Extreme", "Expected", None, None, None, "critical"), ("storms", "Dust", None, None, None, None, None, "medium"), ("storms", "Dust", None, "Immediate", None, None, None, "high"),
    ("treasury_sanctions", "Russia-related", None, "x", None, None, None, "critical"), ("treasury_sanctions", "GLOMAG", None, "x", None, None, None, "high"), ("treasury_sanctions", "x", None, "New designation", None, None, None, "medium"),
    ("threat_pulses", "APT28 again", None, None, 1, None, None, "critical"), ("threat_pulses", "supply-chain", None, None, 1, None, None, "high"), ("threat_pulses", "phishing", None, None, 100, None, None, "high"), ("threat_pulses", "phishing", None, None, 1, None, None, "medium"), ("threat_pulses", "x", None, None, 20, None, None, "medium"), ("threat_pulses", "x", None, None, 19, None, None, "low"),
    ("patents", "hypersonic glide", None, "A01", None, None, None, "critical"), ("patents", "x", None, "F42B15/01", None, None, None, "critical"), ("patents", "x", None, "F42B1/00", None, None, None, "high"), ("patents", "dual use", None, "A01", None, None, None, "medium"), ("patents", "x", None, "B64U10", None, None, None, "medium"), ("patents", "x", None, "A01", None, None, None, "low"),
    ("power_outages", None, None, None, 500_000, None, None, "critical"), ("power_outages", None, None, None, 24_999, None, None, "low"),
    ("humanitarian_disasters", "Cold wave", "past", None, None, 5, None, "critical"), ("humanitarian_disasters", "Flood", "past", None, None, 1, None, "high"), ("humanitarian_disasters", "Cold wave", "alert", None, None, 1, None, "high"), ("humanitarian_disasters", "Cold wave", "ongoing", None, None, 1, None, "medium"), ("humanitarian_disasters", "Cold wave", "past", None, None, 1, None, "low"),
    ("radiation", None, None, None, 350, None, None, "high"), ("quakes", None, None, None, 7.0, None, None, "critical"), ("quakes", None, None, None, 4.9, None, None, "low"), ("quakes", None, None, None, None, None, None, "low"),
    ("space_weather", "Geomagnetic Storm G5", None, None, None, None, None, "critical"), ("space_weather", "RADIO BLACKOUT R3", None, None, None, None, None, "medium"), ("space_weather", "RADIO BLACKOUT r3", None, None, None, None, None, "low"), ("space_weather", "G5", None, None, None, None, None, None),
    ("tsunamis", "Tsunami Warning", None, None, None, None, None, "critical"), ("tsunamis", "Information statement", None, None, None, None, None, "low"), ("tsunamis", "x", None, None, None, None, None, "medium"), ("tsunamis", None, None, None, None, None, None, "medium"),
    ("displacement", "x", None, None, 1_000_000, 1, None, "critical"), ("displacement", "x", None, None, 5, 8, None, "critical"), ("displacement", "influx", None, None, 5, 1, None, "high"), ("displacement", "x", None, None, 10_000, 1, None, "medium"), ("displacement", "x", None, None, 5, 1, None, "low"),
    ("disease_outbreaks", "Ebola", None, None, None, None, None, "critical"), ("disease_outbreaks", "large-scale", None, None, None, None, None, "high"), ("disease_outbreaks", "dengue", None, None, None, None, None, "medium"), ("disease_outbreaks", "x", None, None, None, None, None, "low"),
    ("unheard of", "Ebola", None, None, 1e9, None, None, None), (None, None, None, None, None, None, None, None),
]


def test_known_rows(spark):
    assert {k[0] for k in KNOWN} >= set(FR.FEEDS)
    rows = [(i, *(float(x) if n == 4 and x is not None else x for n, x in enumerate(k))) for i, k in enumerate(KNOWN)]
    table = spark.createDataFrame(rows, "n int, feed string, text string, status string, code string, measure double, places int, days int, wanted string")
    wrong = [r for r in table.withColumn("got", FR.severity()).collect() if r.got != r.wanted]
    assert not wrong
    kept = FR.reported(table).collect()
    assert len(kept) == sum(k[-1] is not None for k in KNOWN)
    assert {(r.feed, r.status, r.category) for r in kept if r.feed == "aircraft_squawks"} == {("aircraft_squawks", "7500", "security"), ("aircraft_squawks", "7600", "security"), ("aircraft_squawks", "7700", "disaster")}
    assert all(r.category for r in kept)


def test_a_key_is_silent_for_its_feeds_time(spark):
    rows = [("internet_outages", 1, 0), ("internet_outages", 2, 1799), ("internet_outages", 3, 1800), ("quakes", 4, 0), ("quakes", 5, 172_799), ("quakes", 6, 172_800)]
    table = spark.createDataFrame(rows, "feed string, id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in Z.ttl_first(table, ["feed"], "ts", "id", FR.quiet_seconds()).collect()) == [1, 3, 4, 6]
