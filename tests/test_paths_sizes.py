import pytest
from pyspark.sql import functions as F

from sheaf.functions import paths, sizes
from sheaf.functions.languages import detect_language

V = F.col("v")

# fixed values: what arguments mean
SIZES = [
    ("100B", 100),
    ("1KB", 1024),
    ("1MB", 1024**2),
    ("1GB", 1024**3),
    ("1TB", 1024**4),
    (" 10 mb ", 10 * 1024**2),
    ("+5B", 5),
    ("100", None),
    ("-1MB", None),
    ("0KB", None),
    ("", None),
    ("100XB", None),
    ("1.5MB", None),
    ("MB", None),
    ("99999999999999999999B", None),
]


def test_parse_size_column(column_of):
    assert column_of([s for s, _ in SIZES], sizes.parse_size_column(V)) == [n for _, n in SIZES]


@pytest.mark.parametrize("text, want", SIZES[:-1])
def test_parse_size_argument(text, want):
    if want is None:
        with pytest.raises(ValueError):
            sizes.parse_size(text)
    else:
        assert sizes.parse_size(text) == want


def test_format_size(column_of):
    rows = [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1024**2, "1.0 MB")]
    rows += [(1024 + 256, "1.2 KB"), (1024 + 768, "1.8 KB"), (5 * 1024**3, "5.0 GB"), (2**62, "4.0 EB")]
    assert column_of([n for n, _ in rows], sizes.format_size(V), "bigint") == [t for _, t in rows]


def test_language_table(column_of):
    rows = [("a.go", "go"), ("test.JAVA", "java"), ("x/y.py", "python"), ("a.js", "javascript"), ("a.ts", "typescript")]
    rows += [("a.html", "html"), ("a.css", "css"), ("a.cpp", "cpp"), ("a.cc", "cpp"), ("a.h", "cpp"), ("a.cs", "csharp")]
    rows += [("a.php", "php"), ("a.rb", "ruby"), ("a.sh", "bash"), ("a.bash", "bash"), ("a.swift", "swift")]
    rows += [("a.kt", "kotlin"), ("a.sql", "sql"), ("a.txt", None), ("a", None), ("d.go/a", None), (".go", "go")]
    assert column_of([p for p, _ in rows], detect_language(V)) == [x for _, x in rows]


def test_name_extension_strip(column_of):
    rows = [("a/b.tar.gz", "b.tar.gz", "gz", "a/b.tar"), ("a.b/c", "c", "", "a.b/c"), ("x.", "x.", "", "x")]
    rows += [(".bashrc", ".bashrc", "bashrc", ""), ("/r/Q.JPG", "Q.JPG", "JPG", "/r/Q")]
    given = [r[0] for r in rows]
    assert column_of(given, paths.base_name(V)) == [r[1] for r in rows]
    assert column_of(given, paths.extension(V)) == [r[2] for r in rows]
    assert column_of(given, paths.strip_extension(V)) == [r[3] for r in rows]


def test_clean_path(column_of):
    rows = [("a/./b", "a/b"), ("a//b/", "a/b"), ("/../a", "/a"), ("../a", "../a"), ("a/../../b", "../b")]
    rows += [("", "."), (".", "."), ("/", "/"), ("/a/..", "/"), ("a/b", "a/b"), ("a/..", "."), ("../../x", "../../x")]
    assert column_of([p for p, _ in rows], paths.clean_path(V)) == [w for _, w in rows]


def test_relative_path(column_of):
    rows = [
        ("/base/dir/file.txt", "file.txt"),
        ("/base/dir/nested/file.txt", "nested/file.txt"),
        ("/base/dir/./nested/../file.txt", "file.txt"),
        ("/other/dir/file.txt", "/other/dir/file.txt"),
        # a segment boundary is required
        ("/base/dir2/file.txt", "/base/dir2/file.txt"),
    ]
    for base in ("/base/dir", "/base/dir/"):
        assert column_of([p for p, _ in rows], paths.relative_path(V, base)) == [w for _, w in rows]


@pytest.mark.parametrize(
    "work, given, want",
    [
        ("/home/user/project", "/home/user/project/file.go", "project/file.go"),
        ("/home/user/project", "/home/user/project/src/main.go", "project/src/main.go"),
        ("/home/user/project", "/other/path/file.go", "project/other/path/file.go"),
        ("/home/user/project", "src/file.go", "project/src/file.go"),
        ("project", "file.go", "project/file.go"),
        ("/home/user/project", "", "project"),
        ("/home/user/project", "/home/user/project/../project/file.go", "project/file.go"),
        ("C:\\Users\\user\\project", "C:\\Users\\user\\project\\file.go", "project/file.go"),
        ("/home/user/project", "/home/user/project2/f", "project/home/user/project2/f"),
        ("/home/user/project", "../up.go", "up.go"),
        ("/home/user/project", "/home/user/project", "project"),
    ],
)
def test_display_path(column_of, work, given, want):
    assert column_of([given], paths.display_path(V, work)) == [want]


def test_common_segments(column_of):
    rows = [("dir1/subdir", 2), ("dir1/other", 1), ("dir2", 0), ("", 0), ("dir1/subdir/x/y", 2), ("/dir1/a", 1)]
    other = F.array(F.lit("dir1"), F.lit("subdir"))
    assert column_of([p for p, _ in rows], paths.common_segments(paths.segments(V), other)) == [n for _, n in rows]
