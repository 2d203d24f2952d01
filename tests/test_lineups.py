"""Line-ups from running text, and labels."""

from tentpole.functions import lineups


def test_acts_are_split_at_what_separates_them(spark):
    cases = {
        "Nova, Kosmos , uvm, Die Wiese": ["Nova", "Kosmos", "Die Wiese"],
        "Nova (Techno) Kosmos (Deep House) Wiese": ["Nova", "Kosmos", "Wiese"],
        "17:30 Nova 19:45 Uhr Kosmos 21.00 Wiese": ["Nova", "Kosmos", "Wiese"],
        "Nova Allstars": ["Nova Allstars"],
        "Nova, Kosmos Kategorie: Rock, Pop": ["Nova", "Kosmos"],
        "Nova Kosmos Wiese Sonne Mond Sterne und noch ein Name": [],
        "Tom &amp; Jerry, Nova": ["Tom & Jerry", "Nova"],
        "": [], None: [], "x" * 20000: [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(lineups.acts("t")).collect()] == list(cases.values())


def test_labels_leave_out_what_is_unknown(spark):
    df = spark.createDataFrame([("Lund", "SE"), ("", "SE"), ("Lund", None), (None, "")], "city string, country string")
    assert [r[0] for r in df.select(lineups.location("city", "country")).collect()] == ["Lund, SE", "SE", "Lund", ""]


def test_forwarding_links_give_their_target(spark):
    df = spark.createDataFrame([("https://a.example/go?x=1&url=https%3A%2F%2Fb.example%2F",), ("https://a.example/?goto=https://c.example",), ("https://a.example/",), (None,)], "u string")
    assert [r[0] for r in df.select(lineups.link_target("u")).collect()] == ["https://b.example/", "https://c.example", "https://a.example/", ""]
