"""Tables and the mail model's views over them."""
