import pytest

from readcollapse.cli import parsed
from readcollapse.options import DedupOptions, output_names, parse_slices


@pytest.mark.parametrize(
    ("text", "slices"),
    [
        ("12", [slice(12)]),
        ("-3,0", [slice(-3), slice(0)]),
        (" 2 : 9 ,+4", [slice(2, 9), slice(4)]),
        ("1:None", [slice(1, None)]),
        (":-2:3,None", [slice(None, -2, 3), slice(None)]),
        (",:", [slice(None), slice(None, None)]),
        ("9:1:-2", [slice(9, 1, -2)]),
    ],
)
def test_slices(text, slices):
    assert parse_slices(text) == slices


@pytest.mark.parametrize(("text", "error"), [("x", ValueError), ("1:y", ValueError), ("2.5", ValueError), ("1 2", ValueError), (":::", TypeError), ("4:3:2:1,8", TypeError)])
def test_bad_slices(text, error):
    with pytest.raises(error):
        parse_slices(text)


@pytest.mark.parametrize(
    "bad",
    [
        {"max_distance": -1},
        {"metric": "cosine"},
        {"method": "none"},
        {"phred_offset": 127},
        {"inputs": ("a", "b"), "outputs": ("c",)},
        {"inputs": ("a", "b"), "slices": (slice(3),)},
        {"slices": (slice(None, None, 0),)},
    ],
)
def test_bad_options(bad):
    with pytest.raises(ValueError):
        DedupOptions(**bad)


def test_command_line():
    options, level = parsed(["a.fq", "b.fq", "-l", "8,", "--edit", "-d", "2", "-c", "adjacency", "-E", "-v", "-q", "-q"])
    assert options.inputs == ("a.fq", "b.fq") and options.outputs == ("collapsed_R1.fastq.gz", "collapsed_R2.fastq.gz")
    assert options.slices == (slice(8), slice(None)) and options.metric == "levenshtein" and options.max_distance == 2
    assert options.method == "adjacency" and not options.filters and level == 30
    defaults, level = parsed(["a.fq", "-o", "x.fq"])
    assert (defaults.max_distance, defaults.max_error_rate, defaults.method, defaults.outputs, level) == (1, 0.001, "directional", ("x.fq",), 20)
    assert output_names(2, None, "p") == ["p1.fastq.gz", "p2.fastq.gz"]
