from loomspan.plans.routing import Source, evidence, factory_points, padded, pick, pick_agent, prepared
from loomspan.retrieval.search import STOP, query_terms

ORDERS = Source("ExportOrders", ("po", "order"), ("BuyerName", "ShipDate"), synonyms=(("customer", "buyer name"),), curated=True)
QUALITY = Source("Quality", ("defect", "dhu"), ("Line", "Checked"), factories=("TAL",))
POLICY = Source("Documents", ("policy", "total leave"), ())


def test_whole_words_only():
    hits = {e.name: e.hits for e in evidence("what is the leave policy", [ORDERS, QUALITY, POLICY])}
    assert hits == {"ExportOrders": 0, "Quality": 0, "Documents": 3}
    assert {e.name: e.hits for e in evidence("total of PO 12", [ORDERS, POLICY])} == {"ExportOrders": 3, "Documents": 0}
    assert padded("Ship-Date, of_TAL") == " ship date of tal "


def test_synonyms_and_compounds():
    assert {e.name: e.hits for e in evidence("by customer", [ORDERS])} == {"ExportOrders": 1}
    assert "ship date" in prepared("shipdate of it", ORDERS) and {e.name: e.hits for e in evidence("shipdate", [ORDERS])} == {"ExportOrders": 1}


def test_a_factory_that_is_named_decides():
    codes = ("TAL", "RHL")
    assert [factory_points(q, QUALITY, codes) for q in ("TAL defects", "RHL defects", "defects", "total defects", "RHL and TAL")] == [4.0, -4.0, 0.0, 0.0, 4.0]
    assert factory_points("RHL defects", ORDERS, codes) == 0.0 and factory_points("defects", QUALITY, codes, "RHL") == -4.0


def test_ranks_ties_and_the_runner_up():
    a, b = Source("Stock", ("item",), similarity=0.3), Source("Issues", ("item",), similarity=0.2)
    assert [(e.name, e.score) for e in evidence("item", [b, a])] == [("Stock", 5.0), ("Issues", 4.0)]
    assert pick("item", [a, b]) == ["Stock", "Issues"] and pick("item", [a, b], margin=0.5) == ["Stock"] and pick("nothing", [Source("X", ("y",))]) == []
    named = [Source("Yarn", ("count",)), Source("Stock", ("count",))]
    assert [e.name for e in evidence("count of stock", named)] == ["Stock", "Yarn"] and [e.name for e in evidence("count", named)] == ["Stock", "Yarn"]
    assert [e.name for e in evidence("item", [Source("Old", ("item",), routable=False), a])] == ["Stock"]


def test_agents_by_whole_words():
    agents = {"orders": ("po", "order"), "hr": ("policy",)}
    assert pick_agent("the policy", agents) == "hr" and pick_agent("the post", agents) is None


def test_words_that_do_not_count():
    assert len(STOP) == 79 and query_terms("what should the colour of each roll be") == ["colour", "roll"] and query_terms("who is there") == ["who", "is", "there"]
