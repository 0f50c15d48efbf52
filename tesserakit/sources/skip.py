"""Which directories and files a scan leaves out, as Column predicates over paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _c

# Directory names that are skipped.
DIRS = """
.git .hg .svn .bzr _darcs .fossil
__pycache__ .mypy_cache .ruff_cache .pytest_cache .tox .nox .eggs .ipynb_checkpoints site-packages
venv .venv env .env .virtualenvs __pypackages__ .pixi .conda
node_modules .npm .yarn .pnpm-store bower_components .next .nuxt .svelte-kit .parcel-cache .turbo
dist build out target bin obj _build cmake-build-debug cmake-build-release
vendor .gradle .m2 packages
.idea .vscode .vs .eclipse .settings .project
htmlcov coverage .nyc_output
.docker .terraform
.cache .sass-cache .eslintcache .stylelintcache .angular .webpack
""".split()
DIR_SUFFIX = ".egg-info"
# File names that are skipped.
FILES = """
.ds_store thumbs.db desktop.ini
.gitignore .gitattributes .gitmodules .gitkeep .git-blame-ignore-revs .editorconfig
setup.cfg manifest.in pip-log.txt pip-delete-this-directory.txt
package-lock.json yarn.lock pnpm-lock.yaml bun.lockb .npmrc .yarnrc .yarnrc.yml .nvmrc .node-version .browserslistrc
cargo.lock go.sum gemfile.lock composer.lock poetry.lock pdm.lock pipfile.lock uv.lock packages.lock.json
.coverage coverage.xml coverage.json .lcov
.dockerignore
.env .env.local .env.development .env.production .env.test .env.staging .env.example .flaskenv
.eslintrc .eslintrc.js .eslintrc.json .eslintrc.yml .prettierrc .prettierrc.js .prettierrc.json .prettierrc.yml .prettierignore
.stylelintrc .stylelintrc.json .babelrc .babelrc.js .postcssrc .commitlintrc .commitlintrc.yml .huskyrc .lintstagedrc
.pylintrc .flake8 .isort.cfg .mypy.ini .bandit .pre-commit-config.yaml .rubocop.yml .scalafmt.conf
.clang-format .clang-tidy .rustfmt.toml rustfmt.toml pyrightconfig.json .terraform.lock.hcl
""".split() + ["icon\r"]
# Endings of file names that are skipped.
SUFFIXES = """
.pyc .pyo .pyd .o .obj .a .lib .so .dll .dylib .class .jar .war .ear
.zip .tar .gz .bz2 .xz .7z .rar .tgz .tar.gz
.exe .msi .app .bin .wasm
.min.js .min.css .map .chunk.js .bundle.js
.ico .icns .cur .ani .woff .woff2 .ttf .otf .eot
.mp3 .mp4 .avi .mov .mkv .flv .wmv .wav .flac .ogg .webm .m4a .aac
.sqlite .sqlite3 .db .db-shm .db-wal .mdb .ldb
.pem .key .crt .cer .p12 .pfx .jks
.tmp .temp .swp .swo .swn .bak .orig .rej ~
.egg-info .egg .whl .dist-info .tfstate .tfstate.backup
""".split()
ENDING = "(" + "|".join(re.escape(s).replace("\\~", "~") for s in SUFFIXES) + ")$"


def skipped_dir(name: str | Column) -> Column:
    """Whether a directory of this bare name is skipped."""
    low = F.lower(_c(name))
    return low.isin(DIRS) | low.endswith(DIR_SUFFIX)


def skipped_file(name: str | Column) -> Column:
    """Whether a file of this bare name is skipped."""
    low = F.lower(_c(name))
    return low.isin(FILES) | low.rlike(ENDING)


def skipped_path(path: str | Column) -> Column:
    """Whether a path has a skipped directory or file; backslashes separate as well, '' and null aren't skipped."""
    parts = F.filter(F.split(F.replace(F.coalesce(_c(path), F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    n = F.size(parts)
    inner = F.exists(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), skipped_dir)
    return F.when(n > 0, inner | skipped_file(F.element_at(parts, -1))).otherwise(False)
