"""Training-data operators read their whole input: nothing is taken from a prefix alone."""

from strandgraph.llm import html_crf


def test_html_counts_digits_over_the_whole_block():
    late, early = "word " * 40 + "12345 " * 60, "12345 " * 40 + "word " * 300
    block = lambda t: html_crf.Block(t.strip(), 0, "p", 0, len(t))
    plain, digits = "word " * 100, "12345 " * 100
    place = set(html_crf.active(block(digits))) - set(html_crf.active(block(plain)))
    assert len(place) == 1
    assert place <= set(html_crf.active(block(late)))
    assert not place & set(html_crf.active(block(early)))
