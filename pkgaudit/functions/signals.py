"""Registry risk signals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgaudit.functions.binding import bind
from pkgaudit.functions.versions import natural_key

# Npm hooks that run at install time.
INSTALL_HOOKS = ("preinstall", "install", "postinstall", "prepare")

# Well-known npm packages, in order of precedence.
KNOWN_NPM = (
    "lodash express react axios commander chalk moment uuid dotenv typescript webpack jest eslint prettier "
    "next vue angular svelte vite rollup esbuild turbo parcel yargs minimist meow inquirer prompts ora "
    "figures semver glob rimraf mkdirp fs-extra cross-env debug winston pino morgan nodemon ts-node tsx "
    "zod joi yup ajv class-validator reflect-metadata sequelize mongoose typeorm knex pg mysql2 sqlite3 "
    "redis ioredis bull bullmq amqplib fastify koa hapi feathers socket.io ws got node-fetch undici "
    "superagent passport jsonwebtoken bcrypt argon2 ramda immer rxjs date-fns dayjs mocha chai sinon nock "
    "supertest vitest husky lint-staged commitlint react-dom react-router redux zustand mobx jotai recoil "
    "tailwindcss styled-components emotion sass graphql apollo-server type-graphql prisma drizzle-orm kysely "
    "sharp jimp multer formidable helmet cors body-parser cookie-parser cheerio puppeteer playwright "
    "selenium-webdriver aws-sdk firebase supabase babel-core autoprefixer postcss cssnano lodash-es luxon"
).split()

# Well-known PyPI packages, in order of precedence.
KNOWN_PYPI = (
    "requests numpy pandas flask django setuptools pip wheel six certifi urllib3 charset-normalizer idna "
    "attrs packaging pyparsing toml pyyaml click fastapi uvicorn starlette pydantic sqlalchemy alembic "
    "pytest hypothesis black flake8 mypy pylint isort boto3 botocore awscli scikit-learn tensorflow torch "
    "keras xgboost lightgbm matplotlib seaborn plotly bokeh pillow opencv-python cryptography paramiko "
    "fabric ansible celery redis psycopg2 pymongo motor sqlmodel tortoise-orm aiohttp httpx websockets "
    "grpcio protobuf jinja2 markupsafe werkzeug wtforms marshmallow arrow pendulum python-dateutil pytz "
    "humanize rich typer loguru tqdm more-itertools pytest-django pytest-asyncio pytest-cov coverage scrapy "
    "beautifulsoup4 lxml html5lib google-cloud-storage azure-storage-blob openai anthropic langchain "
    "transformers sympy scipy statsmodels pydantic-settings python-dotenv dynaconf"
).split()

KNOWN_NAMES = {"npm": KNOWN_NPM, "pypi": KNOWN_PYPI}


def _nearest(lower: Column, known: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in known])
    scored = F.transform(
        names,
        lambda k, i: F.when(
            F.abs(F.length(k) - F.length(lower)) <= 2,
            F.struct(F.levenshtein(lower, k, 2).alias("distance"), i.alias("place"), k.alias("known")),
        ),
    )
    close = F.filter(scored, lambda s: s["distance"].between(1, 2))
    return F.when(~F.array_contains(names, lower), F.array_min(close)["known"])


def local_name(name: Column) -> Column:
    """A name without its scope, in lower case."""
    return F.lower(F.when(name.startswith("@"), F.coalesce(F.get(F.split(name, "/"), F.lit(1)), name)).otherwise(name))


def with_deletions(text: Column, edits: int = 2) -> Column:
    """Hashes of a text and of all that is left of it without one or two of its characters, each once.

    Two texts within two edits of each other have one of these in common. With `edits` of 1 one character at most is
    left out: enough for texts within one edit.
    """
    def shorter(t: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))
        return F.array_distinct(F.transform(places, lambda i: F.concat(
            F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))

    def both(once: Column) -> Column:
        twice = [F.flatten(F.transform(once, shorter))] if edits > 1 else []
        return F.transform(F.array_distinct(F.concat(F.array(text), once, *twice)), lambda t: F.xxhash64(t))

    return bind(shorter(text), both)


def typosquat_candidate(ecosystem: Column, name: Column) -> Column:
    """Nearest well-known name within two edits; null for a known name itself or none near.

    The lists are fixed and short, so each name is compared in its own row, without a join.
    """
    lower = local_name(name)
    return F.when(ecosystem == "npm", _nearest(lower, KNOWN_NPM)).when(
        ecosystem == "pypi", _nearest(lower, KNOWN_PYPI)
    )


def new_maintainers(current: Column, previous: Column) -> Column:
    """Current maintainers that were not there before, repeats kept."""
    return F.filter(current, lambda m: ~F.array_contains(previous, m))


def install_hooks(scripts: Column) -> Column:
    """The install-time hooks among a package's scripts."""
    return F.map_filter(scripts, lambda k, v: k.isin(*INSTALL_HOOKS) & (F.coalesce(v, F.lit("")) != ""))


def version_before(versions: Column, latest: Column) -> Column:
    """Version just before the latest in natural order; null when the latest is first or not listed."""
    keyed = F.transform(versions, lambda v: F.struct(natural_key(v).alias("key"), v.alias("version")))
    earlier = F.filter(keyed, lambda k: k["key"] < natural_key(latest))
    return F.when(F.array_contains(versions, latest), F.array_max(earlier)["version"])


def registry_risk_score(
    maintainer_changed: Column, age_days: Column, published_days: Column, typosquat: Column,
    confusion: Column, provenance: Column,
) -> Column:
    """0 to 10 from the registry signals."""

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    total = (
        points(maintainer_changed, 3) + points(age_days < 30, 2) + points(published_days < 3, 1)
        + points(typosquat.isNotNull(), 3) + points(confusion, 3)
        + points(~provenance & (age_days > 365), 1)
    )
    return F.least(total, F.lit(10))
