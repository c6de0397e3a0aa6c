"""Well-known package names per ecosystem, most popular first: of two names that
are equally near, the earlier one is taken for the target. Pass a table of your
own for a fuller list."""

# The names, in order of popularity.
KNOWN_NAMES = {
    "npm": [
        "react", "react-dom", "lodash", "axios", "express", "chalk", "commander", "debug", "moment",
        "request", "async", "lodash.merge", "vue", "webpack", "babel-core", "eslint", "prettier",
        "typescript", "jest", "mocha", "chai", "sinon", "dotenv", "uuid", "glob", "rimraf", "mkdirp",
        "minimist", "yargs", "left-pad", "cross-env", "colors", "inquirer", "body-parser", "cors",
        "mongoose", "socket.io", "next", "nuxt", "svelte", "redux", "rxjs", "graphql", "apollo-client",
        "tailwindcss", "postcss", "vite", "rollup", "esbuild", "typescript-eslint", "core-js",
        "regenerator-runtime", "jquery", "bootstrap", "material-ui", "styled-components", "immer", "zod",
        "yup", "dayjs", "luxon", "ramda", "underscore", "bluebird", "qs", "form-data",
    ],
    "pypi": [
        "requests", "urllib3", "numpy", "pandas", "flask", "django", "scipy", "matplotlib", "pytest",
        "setuptools", "pip", "wheel", "six", "python-dateutil", "pyyaml", "certifi", "idna",
        "charset-normalizer", "urllib", "click", "jinja2", "markupsafe", "werkzeug", "itsdangerous",
        "sqlalchemy", "psycopg2", "boto3", "botocore", "s3transfer", "pydantic", "attrs", "colorama",
        "tqdm", "rich", "typer", "httpx", "aiohttp", "fastapi", "uvicorn", "gunicorn", "celery", "redis",
        "pymongo", "cryptography", "pillow", "scikit-learn", "tensorflow", "torch", "transformers",
        "openai", "anthropic", "black", "flake8", "mypy", "isort", "poetry", "virtualenv",
        "typing-extensions", "protobuf", "grpcio", "kubernetes", "docker", "boto", "faker", "freezegun",
    ],
    "cargo": [
        "serde", "serde_json", "tokio", "rand", "regex", "log", "libc", "clap", "syn", "quote",
        "proc-macro2", "lazy_static", "chrono", "itertools", "anyhow", "thiserror", "reqwest", "hyper",
        "bytes", "futures", "cfg-if", "once_cell", "bitflags", "num-traits", "smallvec", "indexmap",
        "hashbrown", "tracing", "tracing-subscriber", "axum", "tower", "http", "url", "uuid", "toml",
        "serde_yaml", "rayon", "crossbeam", "parking_lot", "dashmap", "nom", "winnow", "regex-syntax",
        "memchr", "aho-corasick", "unicode-ident", "pin-project", "socket2", "mio", "signal-hook",
        "parking_lot_core",
    ],
    "go": [
        "github.com/gin-gonic/gin", "github.com/stretchr/testify", "golang.org/x/crypto",
        "golang.org/x/net", "golang.org/x/sys", "golang.org/x/text", "google.golang.org/grpc",
        "google.golang.org/protobuf", "github.com/spf13/cobra", "github.com/spf13/viper",
        "github.com/sirupsen/logrus", "go.uber.org/zap", "github.com/pkg/errors",
        "github.com/google/uuid", "github.com/gorilla/mux", "github.com/gorilla/websocket",
        "gorm.io/gorm", "github.com/lib/pq", "github.com/go-sql-driver/mysql",
        "github.com/redis/go-redis", "go.mongodb.org/mongo-driver",
        "github.com/prometheus/client_golang",
    ],
    "composer": [
        "phpunit/phpunit", "symfony/console", "symfony/http-foundation", "monolog/monolog",
        "guzzlehttp/guzzle", "laravel/framework", "illuminate/support", "psr/log", "nikic/php-parser",
        "phpstan/phpstan", "squizlabs/php_codesniffer", "doctrine/orm", "twig/twig", "league/flysystem",
        "ramsey/uuid", "nesbot/carbon",
    ],
    "rubygems": [
        "rails", "rake", "bundler", "rspec", "rspec-core", "activesupport", "activerecord", "actionpack",
        "minitest", "nokogiri", "faraday", "json", "puma", "devise", "sidekiq", "pg", "mysql2", "redis",
        "dotenv", "pry", "rubocop", "simplecov",
    ],
}
