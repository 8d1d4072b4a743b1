"""Input columns that have the names of helper columns come back as they were."""

from reviewmill.llm import lines, minhash, urls


def test_helper_names_in_the_input(make):
    text = "a line of several words that stands here twice"
    kinds = "_id string, _version string, _places string, _gone string, gone string, any_kept string"
    rows = [(i, text, *[f"v{i}"] * 6) for i in (1, 2)]
    df = make(rows, f"doc_id bigint, text string, {kinds}")
    assert [tuple(r) for r in minhash.drop_near_duplicates(df).collect()] == rows[:1]
    assert sorted(tuple(r) for r in lines.drop_repeated_lines(df).collect()) == [rows[0], (2, "", *rows[1][2:])]
    pages = make([("http://a.com/fr/x", "u", "g", "r", "q")], "url string, _url string, _grams string, _rule string, _ratios string")
    out = urls.filter_urls(pages).first()
    assert (out["_url"], out["_grams"], out["_rule"], out["_ratios"], out["verdict"]) == ("u", "g", "r", "q", "allow")
