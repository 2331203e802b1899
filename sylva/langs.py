"""Languages, path rules and kinds: the values that define what is mapped."""

from __future__ import annotations

# Extension -> language, package entry stems, directories never
# entered, segments and names of tests, kinds and levels of detail.
EXTENSIONS = {
    "py": "python", "pyi": "python",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript",
    "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
}
LANGUAGES = ("python", "typescript", "rust", "go", "java", "c", "cpp")
VENDORED = ("node_modules", "target", "dist", "build", "out", "venv", "env", "__pycache__", "site-packages", "vendor", "third_party", "coverage")
PACKAGE_STEMS = ("__init__", "mod", "index")
TEST_SEGMENTS = ("test", "tests", "testing", "__tests__", "spec", "specs")
KINDS = ("function", "method", "class", "interface", "enum", "type", "constant", "module", "field")
TYPE_KINDS = ("class", "interface", "enum", "type")
DETAILS = ("full", "public-only", "public-only-params-elided")
PRESETS = {"small": 1024, "default": 2048, "large": 4096, "review": 8192}
# Names of languages that are known but not mapped, by extension.
UNSUPPORTED_NAMES = {
    "rb": "Ruby", "erb": "Ruby", "rake": "Ruby", "gemspec": "Ruby",
    "php": "PHP",
    "swift": "Swift",
    "kt": "Kotlin", "kts": "Kotlin",
    "cs": "C#",
    "scala": "Scala", "sc": "Scala",
    "m": "Objective-C", "mm": "Objective-C",
    "lua": "Lua",
    "pl": "Perl", "pm": "Perl",
    "dart": "Dart",
    "ex": "Elixir", "exs": "Elixir",
    "erl": "Erlang", "hrl": "Erlang",
    "hs": "Haskell",
    "clj": "Clojure", "cljs": "Clojure", "cljc": "Clojure",
    "sh": "shell scripts", "bash": "shell scripts", "zsh": "shell scripts",
    "zig": "Zig",
    "jl": "Julia",
    "ml": "OCaml", "mli": "OCaml",
}
TOKEN_DEFAULT = PRESETS["default"]
