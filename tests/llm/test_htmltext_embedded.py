from tideline.llm import htmltext as H


def test_only_scripts_and_styles_are_skipped():
    page = "<body><noscript>a</noscript><object data=x>b</object><svg><text>c</text></svg><p>x <math><mi>y</mi></math> z</p><template><p>d</p></template><iframe>e</iframe><svg/>f<script>g</script><style>h</style></body>"
    texts, paths, linked = H.blocks(page)
    assert texts == ["a", "b", "c", "x y z", "d", "e", "f"] and len(paths) == len(linked) == 7


def test_a_missing_end_tag_loses_nothing_after_it():
    for tag in ("object", "svg", "noscript", "template", "iframe", "math", "script", "style"):
        assert H.blocks(f"<body><{tag} id=x><article><p>One.</p><p>Two.</p></article></body>")[0] == ["One.", "Two."], tag
