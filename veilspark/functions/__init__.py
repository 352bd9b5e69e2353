"""Column functions: text helpers, detection rules, the redaction fold, action checks."""
