"""Extensions and what they are parsed as, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _c, file_name, suffix

# Extensions of source code and their languages.
LANGUAGES = dict(
    pair.split(":")
    for pair in """
.py:python .pyw:python .js:javascript .mjs:javascript .cjs:javascript .jsx:javascript-react .ts:typescript .tsx:typescript-react
.java:java .kt:kotlin .kts:kotlin .scala:scala .c:c .h:c-header .cpp:cpp .cxx:cpp .cc:cpp .hpp:cpp-header .hxx:cpp-header .cs:csharp
.go:go .rs:rust .rb:ruby .php:php .swift:swift .m:objective-c .mm:objective-cpp .r:r .lua:lua .pl:perl .pm:perl
.sh:shell .bash:shell .zsh:shell .fish:shell .ps1:powershell .psm1:powershell .bat:batch .cmd:batch .sql:sql .dart:dart
.ex:elixir .exs:elixir .erl:erlang .hrl:erlang .hs:haskell .ml:ocaml .mli:ocaml .fs:fsharp .fsx:fsharp .clj:clojure .cljs:clojure
.groovy:groovy .gradle:groovy .vim:vim .el:emacs-lisp .zig:zig .v:v .nim:nim .tf:terraform .hcl:hcl .proto:protobuf
.graphql:graphql .gql:graphql .vue:vue .svelte:svelte .toml:toml .ini:ini .cfg:ini .conf:config .env:dotenv
.properties:properties .makefile:makefile .cmake:cmake .dockerfile:dockerfile
""".split()
)
# Names of code files that have no extension.
NAMED = {"makefile": "makefile", "dockerfile": "dockerfile", "jenkinsfile": "groovy", "vagrantfile": "ruby", "gemfile": "ruby", "rakefile": "ruby", "cmakelists.txt": "cmake"}
# Extensions of each other format.
FORMATS = {
    "txt": ".txt .text",
    "markdown": ".md .markdown",
    "pdf": ".pdf",
    "docx": ".docx",
    "pptx": ".pptx",
    "xlsx": ".xlsx .xls",
    "html": ".html .htm",
    "csv": ".csv .tsv",
    "json": ".json .jsonl",
    "yaml": ".yaml .yml",
    "xml": ".xml .xsl .xslt .xsd .svg .rss .atom",
    "rst": ".rst .rest",
    "rtf": ".rtf",
    "odt": ".odt",
    "ods": ".ods",
    "odp": ".odp",
    "epub": ".epub",
    "log": ".log",
    "image": ".png .jpg .jpeg .gif .bmp .tiff .tif .webp .ico .heic .heif",
}
FORMAT_OF = {e: f for f, es in FORMATS.items() for e in es.split()} | dict.fromkeys(LANGUAGES, "code")
EXTENSIONS = sorted(FORMAT_OF)


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def format_of(path: str | Column) -> Column:
    """The format a file is parsed as by its extension; null if there is no parser."""
    return _lookup(FORMAT_OF, suffix(path))


def language_of(path: str | Column) -> Column:
    """A code file's language by extension or name, 'unknown' else."""
    return F.coalesce(_lookup(LANGUAGES, suffix(path)), _lookup(NAMED, F.lower(file_name(path))), F.lit("unknown"))


def supported(path: str | Column) -> Column:
    return suffix(_c(path)).isin(sorted(FORMAT_OF))
