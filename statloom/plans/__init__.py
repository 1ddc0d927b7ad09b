"""From script text to typed commands, expressions and frames."""
