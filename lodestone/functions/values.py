"""They must equal these for right results. Listed plainly, in natural order."""

# --- fixed values: query gate -------------------------------------------------------------
ACKNOWLEDGEMENTS = [
    "yes", "yeah", "ok", "sure", "right", "exactly", "correct", "agreed", "nice", "cool", "perfect", "thanks",
    "thank you", "good", "great", "sounds good", "go ahead", "let'?s do (it|that)", "I (agree|allowed it|see)",
]
FILLERS = [
    r"still running\??", r"what'?s going on\??", r"what happened\??", r"is (it|that) done\??", r"are we done\??",
    r"anything else\??", r"what do you think\??", r"how about (it|that)\??", r"I (don'?t know|mean)[,.]?\s*", r"wait[,.]?\s*",
]
INTERRUPTION = r"^\[Request interrupted"
SESSION_REFERENCE = r"^(can we |let'?s |should we )?(consider|close|mark|finish|move)\s+#?\d+"
INJECTED_BLOCKS = ["ide_opened_file", "ide_selection", "task-notification", "system-reminder"]

# --- fixed values: tool queries -----------------------------------------------------------
GIT_QUERIES = {
    "commit": "git commit conventions",
    "push": "git push deploy",
    "checkout": "git branch naming",
    "branch": "git branch naming",
    "rebase": "git rebase workflow",
    "merge": "git merge workflow",
}
GH_QUERIES = {
    "pr create": "pull request create description template",
    "pr view": "pull request review",
    "pr review": "pull request review feedback",
    "pr merge": "pull request merge",
    "issue create": "issue create",
}
TEST_COMMANDS = ["jest", "pytest", "cypress", "vitest", "npx"]
SCRIPT_COMMANDS = ["npm", "yarn", "pnpm"]
PYTHON_COMMANDS = ["pip", "uv"]
EDIT_CONTEXT = {
    ".tsx": "react typescript component",
    ".ts": "typescript",
    ".jsx": "react component",
    ".js": "javascript",
    ".py": "python",
    ".css": "styling css",
    ".scss": "styling scss",
    ".md": "documentation markdown",
}
GENERIC_PARAMETERS = ["file_path", "path", "pattern", "query"]

# --- fixed values: prerequisites inferred from keywords -----------------------------------
KEYWORD_SERVERS = {"figma mcp": ["figma"], "figma server": ["figma"]}

# --- fixed values: workspace tags ---------------------------------------------------------
HOST_TAGS = {r"github\.com": ["github"], r"bitbucket\.org": ["bitbucket"], r"gitlab\.com": ["gitlab"]}
FILE_TAGS = {
    "tsconfig.json": ["typescript"],
    "package.json": [],
    "Gemfile": ["ruby"],
    "requirements.txt": ["python"],
    "Cargo.toml": ["rust"],
    "go.mod": ["golang"],
    "pom.xml": ["java"],
    "build.gradle": ["java"],
    "Dockerfile": ["docker"],
    "docker-compose.yml": ["docker"],
    ".rubocop.yml": ["ruby"],
    "jest.config.js": ["jest"],
    "jest.config.ts": ["jest"],
    "playwright.config.ts": ["playwright"],
    "vite.config.ts": ["vite"],
    "next.config.js": ["nextjs"],
    "nuxt.config.ts": ["nuxtjs"],
}
DIRECTORY_TAGS = {
    "engines": ["monorepo", "rails-engines"],
    "apps": ["monorepo"],
    "packages": ["monorepo"],
    "libs": ["monorepo"],
    "frontend": ["frontend"],
    "backend": ["backend"],
    "components": ["frontend", "react"],
    "pages": ["frontend"],
}
PACKAGE_TAGS = {
    "react": ["react", "frontend"],
    "next": ["nextjs", "react", "frontend"],
    "nuxt": ["nuxtjs", "vue", "frontend"],
    "vue": ["vue", "frontend"],
    "svelte": ["svelte", "frontend"],
    "angular": ["angular", "frontend"],
    "@angular/core": ["angular", "frontend"],
    "express": ["nodejs", "backend"],
    "fastify": ["nodejs", "backend"],
    "koa": ["nodejs", "backend"],
    "hapi": ["nodejs", "backend"],
    "nest": ["nestjs", "nodejs", "backend"],
    "@nestjs/core": ["nestjs", "nodejs", "backend"],
    "node-fetch": ["nodejs"],
    "nodemon": ["nodejs"],
    "pm2": ["nodejs"],
    "mongoose": ["nodejs", "mongodb"],
    "sequelize": ["nodejs", "sql"],
    "prisma": ["nodejs", "sql"],
    "@prisma/client": ["nodejs", "sql"],
    "typescript": ["typescript"],
    "jest": ["jest", "testing"],
    "vitest": ["vitest", "testing"],
    "playwright": ["playwright", "testing"],
    "cypress": ["cypress", "testing"],
}
GEM_TAGS = {"rails": ["rails", "backend"], "rspec": ["rspec", "testing"], "rubocop": ["ruby"]}

# --- fixed values: scoring ----------------------------------------------------------------
EMA_ALPHA, EMA_LIMIT = 0.3, 3.0
PIN_SCORE, UNPIN_SCORE, PIN_EVALUATIONS, PIN_RATE = 0.6, 0.2, 5, 0.8
FEEDBACK_FLOOR, FEEDBACK_EVALUATIONS, FEEDBACK_WEIGHT = -0.1, 3, 0.20
